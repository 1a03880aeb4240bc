"""Column layout of a job posting and of the shapes exchanged with the outside."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and keys of the data model.
TEXT_COLUMNS = [
    "company_name", "company_url", "company_logo", "salary", "experience", "level",
    "work_type", "education", "industry", "location_short", "workplace_detail",
    "working_time", "posted_date", "deadline", "keyword", "job_description",
    "job_requirements", "benefits",
]

EXTRA_INFO = T.StructType([
    T.StructField("duplicate_sources", T.ArrayType(T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("job_url", T.StringType()),
    ]))),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

POSTING = T.StructType(
    [
        T.StructField("job_url", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("job_title", T.StringType(), False),
    ]
    + [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS]
    + [
        T.StructField("extra_info", EXTRA_INFO),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# Columns shown in a "latest postings" list.
SUMMARY_COLUMNS = [
    "job_url", "source", "job_title", "company_name", "company_url", "company_logo",
    "salary", "experience", "level", "work_type", "location_short", "posted_date",
    "deadline", "keyword", "extra_info", "created_at",
]

# Response of a board's listing API: one JSON object with many postings.
API_PAYLOAD = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("jobId", T.StringType()),
    T.StructField("jobUrl", T.StringType()),
    T.StructField("alias", T.StringType()),
    T.StructField("jobTitle", T.StringType()),
    T.StructField("companyName", T.StringType()),
    T.StructField("companyUrl", T.StringType()),
    T.StructField("companyLogo", T.StringType()),
    T.StructField("prettySalary", T.StringType()),
    T.StructField("salaryMin", T.LongType()),
    T.StructField("salaryMax", T.LongType()),
    T.StructField("salaryCurrency", T.StringType()),
    T.StructField("yearsOfExperience", T.StringType()),
    T.StructField("jobLevelVI", T.StringType()),
    T.StructField("jobLevel", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("approvedOn", T.StringType()),
    T.StructField("createdOn", T.StringType()),
    T.StructField("expiredOn", T.StringType()),
    T.StructField("prettyApprovedOn", T.StringType()),
    T.StructField("jobDescription", T.StringType()),
    T.StructField("jobRequirement", T.StringType()),
    T.StructField("companyProfile", T.StringType()),
    T.StructField("companySizeVI", T.StringType()),
    T.StructField("companySize", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StructType([
        T.StructField("skillName", T.StringType())]))),
    T.StructField("benefits", T.ArrayType(T.StructType([
        T.StructField("benefitName", T.StringType())]))),
    T.StructField("workingLocations", T.ArrayType(T.StructType([
        T.StructField("cityName", T.StringType()),
        T.StructField("address", T.StringType())]))),
])))])

PLACE = T.ArrayType(T.StructType([
    T.StructField("address", T.StringType()),
    T.StructField("province_name", T.StringType()),
]))

# One posting inside the JSON a board embeds in its list page.  ``places`` stays text
# because boards send it either as an array or as a string holding one.
EMBEDDED_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("title_slug", T.StringType()),
    T.StructField("other_requirement", T.StringType()),
    T.StructField("other_requirement_html", T.StringType()),
    T.StructField("employer_info", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("logo", T.StringType()),
        T.StructField("website", T.StringType())])),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("places", T.StringType()),
    T.StructField("resume_apply_expired", T.LongType()),
    T.StructField("created_at", T.LongType()),
    T.StructField("smart_tags", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType())]))),
    T.StructField("experience_range", T.StringType()),
    T.StructField("level_requirement", T.StringType()),
    T.StructField("degree_requirement", T.StringType()),
    T.StructField("working_method", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("vacancy_quantity", T.StringType()),
    T.StructField("probation_duration", T.StringType()),
])

EMBEDDED_DOCUMENT = T.StructType([T.StructField("props", T.StructType([
    T.StructField("initialState", T.StructType([
        T.StructField("api", T.StructType([
            T.StructField("getJobList", T.StructType([
                T.StructField("data", T.StructType([
                    T.StructField("items", T.ArrayType(EMBEDDED_ITEM))]))]))]))]))]))])

RUN_LOG = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("jobs", T.LongType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("message", T.StringType()),
])

TRACKER_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])
