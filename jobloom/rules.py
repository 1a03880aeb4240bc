"""Word lists, lookup tables, patterns and labels.

Results depend on these exact values.  Every operator takes its rules as an argument and
uses the tables below only as defaults, so a caller can replace any of them.
"""

# Known sources, in scan order (earlier sources win when copies are merged).
SOURCES = [
    "careerlink", "careerviet", "topcv", "vieclam24h", "vietnamworks",
    "jobsgo", "joboko", "123job", "timviec365", "topdev",
]

# Company-form and generic terms removed before comparing, longest first.
COMPANY_TERMS = [
    "công ty tnhh mtv", "công ty tnhh", "công ty cổ phần", "công ty cp", "công ty",
    "cty tnhh", "cty cp", "cty", "tnhh", r"co\.,\s*ltd", "ltd", "corp", "corporation",
    "group", "jsc", "chi nhánh", "ngân hàng tmcp", "ngân hàng",
]

# Spellings of "not stated" for salary and level.
UNSTATED = [
    "", "thương lượng", "thỏa thuận", "thoa thuan", "thuong luong", "negotiable", "cạnh tranh",
]

# Labels for missing places.
UNKNOWN_LOCATION = "Khác / Chưa rõ"
UNKNOWN_SHORT = "Chưa rõ"
REMOTE_LOCATION = "Toàn quốc / Remote"
HUB_PROVINCES = ["Hà Nội", "Đà Nẵng", "Hồ Chí Minh"]

# Ordered province rules (needles, province); the first hit decides.
PROVINCE_RULES = [
    (["hà nội", "ha noi", "thủ đô", "thành phố hà nội", "hn"], "Hà Nội"),
    (["hồ chí minh", "ho chi minh", "hcm", "tp hcm", "tp. hcm", "sài gòn", "sai gon", "tp.hcm"],
     "Hồ Chí Minh"),
    (["đà nẵng", "da nang", "tp đà nẵng", "tp da nang", "dn"], "Đà Nẵng"),
    (["hải phòng", "hai phong"], "Hải Phòng"),
    (["bình dương", "binh duong"], "Bình Dương"),
    (["bắc ninh", "bac ninh"], "Bắc Ninh"),
    (["đồng nai", "dong nai"], "Đồng Nai"),
    (["hưng yên", "hung yen"], "Hưng Yên"),
    (["hải dương", "hai duong"], "Hải Dương"),
    (["cần thơ", "can tho"], "Cần Thơ"),
    (["bà rịa", "vũng tàu", "ba ria", "vung tau"], "Bà Rịa - Vũng Tàu"),
    (["khánh hòa", "khanh hoa", "nha trang"], "Khánh Hòa"),
    (["quảng ninh", "quang ninh"], "Quảng Ninh"),
    (["thái nguyên", "thai nguyen"], "Thái Nguyên"),
    (["vĩnh phúc", "vinh phuc"], "Vĩnh Phúc"),
    (["thừa thiên huế", "thua thien hue", "huế", "hue"], "Thừa Thiên Huế"),
    (["quảng nam", "quang nam"], "Quảng Nam"),
    (["lâm đồng", "lam dong", "đà lạt", "da lat"], "Lâm Đồng"),
    (["long an"], "Long An"),
    (["nghệ an", "nghe an", "vinh"], "Nghệ An"),
    (["thanh hóa", "thanh hoa"], "Thanh Hóa"),
    (["bắc giang", "bac giang"], "Bắc Giang"),
    (["nam định", "nam dinh"], "Nam Định"),
    (["thái bình", "thai binh"], "Thái Bình"),
    (["hà nam", "ha nam"], "Hà Nam"),
    (["quảng ngãi", "quang ngai"], "Quảng Ngãi"),
    (["bình định", "binh dinh", "quy nhơn"], "Bình Định"),
    (["bình phước", "binh phuoc"], "Bình Phước"),
    (["tây ninh", "tay ninh"], "Tây Ninh"),
    (["tiền giang", "tien giang"], "Tiền Giang"),
    (["bến tre", "ben tre"], "Bến Tre"),
    (["kiên giang", "kien giang", "phú quốc"], "Kiên Giang"),
    (["cà mau", "ca mau"], "Cà Mau"),
    (["toàn quốc", "remote", "toan quoc"], REMOTE_LOCATION),
]

# Ordered sector rules; no hit leaves the sector empty.
SECTOR_RULES = [
    (["bank", "ngân hàng", "fintech", "chứng khoán", "thanh toán", "ví điện tử"],
     "Fintech & Ngân hàng"),
    (["fpt", "viettel", "vnpt", "viễn thông", "telecom"], "Tập đoàn Công nghệ & Viễn thông"),
    (["shopee", "tiki", "lazada", "thương mại", "retail", "e-commerce", "bán lẻ"],
     "Thương Mại Điện Tử & Bán Lẻ"),
    (["game", "unity", "vng", "gameloft"], "Game & Giải Trí Trực Tuyến"),
]

# Technology groups (name, category, pattern, salary note, badge).
TECH_GROUPS = [
    ("React / Next.js", "Framework", r"React|Next.?js", "25 - 45 tr", "Hot 🔥"),
    ("Python / AI / ML", "Language", r"Python|Django|FastAPI|PyTorch|TensorFlow", "30 - 60 tr", "Hot 🔥"),
    ("Java / Spring Boot", "Language", r"Java|Spring", "28 - 50 tr", "Phổ biến ⚡"),
    ("Golang", "Language", r"Go|Golang", "35 - 65 tr", "Tăng trưởng ↗️"),
    ("TypeScript / Node.js", "Language", r"TypeScript|Node.?js|Express|Nest", "25 - 45 tr", "Phổ biến ⚡"),
    ("Automation Test / QA", "Tool", r"Test|QA|QC|Selenium|Appium|Cypress", "20 - 40 tr", "Hot 🔥"),
    ("Docker / Kubernetes / DevOps", "Database/Cloud", r"Docker|Kubernetes|DevOps|CI.?CD", "35 - 70 tr", "Tăng trưởng ↗️"),
    ("AWS / Cloud Computing", "Database/Cloud", r"AWS|Azure|GCP|Cloud", "32 - 60 tr", "Tăng trưởng ↗️"),
    ("PostgreSQL / SQL / Database", "Database/Cloud", r"Postgres|SQL|MySQL|Database|MongoDB", "25 - 45 tr", "Phổ biến ⚡"),
    ("Flutter / Mobile", "Framework", r"Flutter|React Native|iOS|Android|Mobile|Swift|Kotlin", "22 - 42 tr", "Phổ biến ⚡"),
    (".NET / C#", "Language", r"\.NET|C#|CSharp", "25 - 48 tr", "Phổ biến ⚡"),
    ("Vue.js / Nuxt", "Framework", r"Vue|Nuxt", "22 - 38 tr", "Phổ biến ⚡"),
]

# The five technology groups that use a shorter pattern in the live summary.
TECH_PATTERNS_LIVE = {
    "Python / AI / ML": r"Python|Django|FastAPI|PyTorch",
    "TypeScript / Node.js": r"TypeScript|Node.?js|Express",
    "PostgreSQL / SQL / Database": r"Postgres|SQL|MySQL|Database",
    "Flutter / Mobile": r"Flutter|React Native|iOS|Android|Mobile",
    ".NET / C#": r"\.NET|C#",
}

# Level benchmark (level, range, average in million VND, note).
LEVEL_BENCHMARKS = [
    ("Thực tập / Intern / Fresher", "5 - 12 triệu", 8.5,
     "Dành cho sinh viên mới ra trường hoặc dưới 1 năm kinh nghiệm"),
    ("Nhân viên / Junior", "15 - 25 triệu", 20.0, "Từ 1 - 2 năm kinh nghiệm vững chắc"),
    ("Chuyên viên / Middle", "25 - 40 triệu", 32.5, "Từ 2 - 4 năm kinh nghiệm độc lập"),
    ("Kỹ sư Cấp cao / Senior", "40 - 65 triệu", 52.5, "Trên 5 năm kinh nghiệm, làm chủ hệ thống"),
    ("Trưởng nhóm / Quản lý / Lead", "60 - 100+ triệu", 80.0,
     "Quản lý dự án, Tech Lead, Engineering Manager"),
]

# City benchmark (city, search key, range, average in million VND).
CITY_BENCHMARKS = [
    ("Hà Nội", "Hà Nội", "20 - 55 triệu", 32.0),
    ("Hồ Chí Minh", "Hồ Chí Minh", "22 - 65 triệu", 35.5),
    ("Đà Nẵng", "Đà Nẵng", "18 - 45 triệu", 26.5),
    (REMOTE_LOCATION, "Remote", "25 - 80 triệu", 42.0),
]

# Bot-challenge and block markers looked for in stored pages.
CHALLENGE_MARKERS = [
    "g-recaptcha", "recaptcha/api", "h-captcha", "hcaptcha", "cf-turnstile", "cf-challenge",
    "just a moment...", "ddos-guard", "challenge-platform",
    "attention required! | cloudflare", "<title>bot verification</title>", "vui lòng xác minh",
]
CHALLENGE_WINDOW = 3000
SHORT_PAGE = 500
SHORT_PAGE_MARKERS = ["forbidden", "blocked"]
MIN_DETAIL_CHARS = 1000
BLOCK_STATUSES = [403, 429]

# Label synonyms of detail pages (field, needles) in test order.
LABEL_SYNONYMS = [
    ("posted_date", ["ngày cập nhật", "ngày đăng"]),
    ("industry", ["ngành nghề", "lĩnh vực"]),
    ("work_type", ["hình thức"]),
    ("salary", ["lương"]),
    ("location_short", ["địa điểm", "khu vực"]),
    ("experience", ["kinh nghiệm"]),
    ("level", ["cấp bậc", "chức vụ"]),
    ("education", ["trình độ", "bằng cấp"]),
    ("deadline", ["hạn nộp", "hết hạn", "hạn", "ứng tuyển", "nộp"]),
    ("headcount", ["số lượng"]),
]

# Heading synonyms of the three long text sections, in test order.
SECTION_SYNONYMS = [
    ("job_description", ["mô tả", "role & responsibilities"]),
    ("job_requirements", ["yêu cầu", "skills & qualifications"]),
    ("benefits", ["quyền lợi", "phúc lợi", "chế độ", "benefits"]),
]

# Keyword lists that classify short snippets, in test order.
SPAN_CLASSES = [
    ("location_short", ["hà nội", "hồ chí minh", "đà nẵng", "remote", "hybrid", "hcm", "ha noi", "vietnam"]),
    ("level", ["chuyên viên", "trưởng nhóm", "nhân viên", "quản lý", "intern", "fresher", "junior",
               "middle", "senior", "lead", "manager", "director"]),
    ("experience", ["year", "năm", "tháng", "month", "no experience"]),
]
MAX_SPAN_CHARS = 60

# Substrings that keep a sitemap URL.
SITEMAP_KEYWORDS = [
    "developer", "engineer", "it", "lap-trinh", "phan-mem", "tester", "frontend", "backend",
    "fullstack", "java", "python", "react", "php", "net", "data", "ai", "tech", "system",
    "cloud", "devops", "security", "qa", "qc", "cntt", "mobile", "ios", "android", "embedded",
    "golang",
]

# Markers of closed postings in a title.
CLOSED_MARKERS = ["không tồn tại", "404"]

# Where a company name is cut, the placeholder logo, the shortest usable name
# and the word that marks a date caught by mistake.
COMPANY_CUT = [r"Quy mô:", r"Trụ sở:"]
PLACEHOLDER_IMAGES = ["no_company.png", "logo_v2", "saramin-icon", "facebook.com", "promote_app",
                      "data:image", "cover", "1258x256"]
MIN_COMPANY_CHARS = 4
COMPANY_DATE_WORD = "ngày"

# Export layout (header, column, text when empty).
EXPORT_COLUMNS = [
    ("Chức Danh Công Việc", "job_title", ""),
    ("Tên Công Ty", "company_name", ""),
    ("Mức Lương", "salary", "Thương lượng"),
    ("Khu Vực", "location_short", "Chưa rõ"),
    ("Kinh Nghiệm", "experience", "Không yêu cầu"),
    ("Cấp Bậc", "level", "Chưa xác định"),
    ("Hình Thức Làm Việc", "work_type", "Toàn thời gian"),
    ("Nguồn Tuyển Dụng", "source", ""),
    ("Hạn Nộp Hồ Sơ", "deadline", "Hết hạn theo quy định"),
    ("Ngày Đăng", "posted_date", ""),
    ("Địa Điểm Chi Tiết", "workplace_detail", ""),
    ("Đường Dẫn Ứng Tuyển Gốc", "job_url", ""),
]

# Texts used when a salary is not stated.
SALARY_AGREED = "Thỏa thuận"
SALARY_AGREED_MILLIONS = "Thoả thuận"
SALARY_PLACEHOLDERS = ["", "0", "Thương lượng"]
WORK_FULL_TIME = "Toàn thời gian"
WORK_PART_TIME = "Bán thời gian"
NATIONWIDE = "Toàn quốc"
WORKING_TIME_LABEL = "thời gian làm việc"
MAX_WORKING_TIME = 250

# Fields a detail page may override on a list card.
DETAIL_FIELDS = [
    "job_title", "company_name", "company_url", "company_logo", "salary", "experience",
    "keyword", "deadline", "job_description", "job_requirements", "benefits",
]

# Share of a source (percent, at least) and its heat label.
HEAT_TIERS = [(25, "Cực nóng 🔥"), (15, "Rất nóng ⚡"), (8, "Ấm áp ♨️")]
HEAT_FLOOR = "Bình ổn ❄️"

# Posting count (at least) and its marker size; above zero is 9, zero is 6.
SIZE_TIERS = [(1000, 34), (100, 24), (50, 18), (20, 14), (10, 11), (1, 9)]
SIZE_FLOOR = 6

# How a role's postings spread over levels (share, least count) and cities
# (pay multiplier, share).
LEVEL_SPLIT = [(0.08, 1), (0.45, 2), (0.32, 2), (0.12, 1), (0.03, 1)]
CITY_SPLIT = [("Hà Nội", 1.0, 0.48), ("Hồ Chí Minh", 1.08, 0.44), ("Đà Nẵng", 0.82, 0.08),
              (REMOTE_LOCATION, 1.22, 0.08)]
ROLE_COUNT_FOR_LEVELS = 30
ROLE_COUNT_FOR_CITIES = 10
BAR_FLOOR = 60.0
LEVEL_BAR_MAX = 80.0

# States of a tracked posting.
TRACKER_STATES = ["saved", "applied", "interviewing", "offered", "rejected"]
TRACKER_REMOVED = "removed"

# Weights and thresholds of fuzzy search.
SCORE_WEIGHTS = {"job_title": 45.0, "company_name": 20.0, "keyword": 15.0, "job_requirements": 10.0}
SCORE_CONTAINS = {"job_title": 25.0, "company_name": 15.0}
SCORE_MIN, SCORE_MAX = 10, 100
SUBSTRING_COLUMNS = ["job_title", "company_name", "keyword", "location_short",
                     "job_requirements", "job_description"]
FUZZY_THRESHOLDS = {"job_title": 0.08, "company_name": 0.12, "keyword": 0.12}

# Map nodes (name, region, latitude, longitude, aliases).
GEO_NODES = [
    ("Hà Nội", "north", 21.0285, 105.8542, ["ha noi", "tp hà nội", "tp hanoi"]),
    ("Hải Phòng", "north", 20.8449, 106.6881, ["hai phong", "tp hải phòng"]),
    ("Quảng Ninh", "north", 20.9599, 107.0425, ["quang ninh", "hạ long"]),
    ("Bắc Ninh", "north", 21.1861, 106.0763, ["bac ninh"]),
    ("Hưng Yên", "north", 20.6464, 106.0511, ["hung yen"]),
    ("Hải Dương", "north", 20.9373, 106.3146, ["hai duong"]),
    ("Vĩnh Phúc", "north", 21.3089, 105.6049, ["vinh phuc"]),
    ("Thái Nguyên", "north", 21.5928, 105.8442, ["thai nguyen"]),
    ("Bắc Giang", "north", 21.2731, 106.1946, ["bac giang"]),
    ("Phú Thọ", "north", 21.3228, 105.228, ["phu tho", "việt trì"]),
    ("Hà Nam", "north", 20.545, 105.912, ["ha nam", "phủ lý"]),
    ("Nam Định", "north", 20.4344, 106.1773, ["nam dinh"]),
    ("Thái Bình", "north", 20.4463, 106.3366, ["thai binh"]),
    ("Thanh Hóa", "north", 19.8067, 105.7852, ["thanh hoa"]),
    ("Nghệ An", "north", 18.6734, 105.6813, ["nghe an", "vinh"]),
    ("Hà Tĩnh", "north", 18.3429, 105.9059, ["ha tinh"]),
    ("Đà Nẵng", "central", 16.0544, 108.2022, ["da nang", "tp đà nẵng", "tp danang"]),
    ("Thừa Thiên Huế", "central", 16.4637, 107.5909, ["thua thien hue", "huế", "hue"]),
    ("Quảng Trị", "central", 16.8163, 107.1001, ["quang tri"]),
    ("Quảng Bình", "central", 17.469, 106.6225, ["quang binh", "đồng hới"]),
    ("Quảng Nam", "central", 15.5651, 108.4815, ["quang nam", "hội an", "tam kỳ"]),
    ("Quảng Ngãi", "central", 15.1205, 108.7923, ["quang ngai"]),
    ("Bình Định", "central", 13.782, 109.2197, ["binh dinh", "quy nhơn"]),
    ("Phú Yên", "central", 13.0882, 109.3075, ["phu yen", "tuy hòa"]),
    ("Khánh Hòa", "central", 12.2388, 109.1967, ["khanh hoa", "nha trang"]),
    ("Đắk Lắk", "central", 12.6667, 108.0383, ["dak lak", "đắc lắc", "buôn ma thuột"]),
    ("Gia Lai", "central", 13.9833, 108.0, ["gia lai", "pleiku"]),
    ("Lâm Đồng", "central", 11.9404, 108.4583, ["lam dong", "đà lạt"]),
    ("Bình Thuận", "central", 10.9273, 108.1022, ["binh thuan", "phan thiết"]),
    ("Hồ Chí Minh", "south", 10.8231, 106.6297,
     ["ho chi minh", "tp. hồ chí minh", "tp hồ chí minh", "tp hcm", "hcm", "sài gòn", "saigon"]),
    ("Bình Dương", "south", 11.1606, 106.657, ["binh duong", "thủ dầu một"]),
    ("Đồng Nai", "south", 10.9575, 106.8426, ["dong nai", "biên hòa"]),
    ("Bà Rịa - Vũng Tàu", "south", 10.4966, 107.1685, ["ba ria vung tau", "vũng tàu", "bà rịa vũng tàu"]),
    ("Tây Ninh", "south", 11.31, 106.098, ["tay ninh"]),
    ("Bình Phước", "south", 11.533, 106.883, ["binh phuoc", "đồng xoài"]),
    ("Long An", "south", 10.5361, 106.4116, ["long an", "tân an"]),
    ("Tiền Giang", "south", 10.36, 106.36, ["tien giang", "mỹ tho"]),
    ("Bến Tre", "south", 10.243, 106.375, ["ben tre"]),
    ("Cần Thơ", "south", 10.0452, 105.7469, ["can tho", "tp cần thơ"]),
    ("Đồng Tháp", "south", 10.4578, 105.6331, ["dong thap", "cao lãnh"]),
    ("An Giang", "south", 10.3759, 105.4185, ["an giang", "long xuyên"]),
    ("Kiên Giang", "south", 10.0125, 105.0809, ["kien giang", "rạch giá", "phú quốc"]),
    ("Cà Mau", "south", 9.1769, 105.1524, ["ca mau"]),
]

# The page title's pattern around a posting's title, and the words before it
RECRUITING_TITLE = r"(?i)Recruiting\s+(.+?)\s+at\s+"
RECRUITING_WORDS = "Tuyển dụng"

# Pay bands as factors of a role's least, average and greatest pay
BAND_EDGES = {
    "fresher": (("min", 0.7), ("min", 1.1)), "middle": (("avg", 0.75), ("avg", 1.15)),
    "senior": (("avg", 1.15), ("max", 0.95)), "lead": (("max", 0.9), ("max", 1.35)),
}
