"""SQL names for the functions, so they can be used from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from jobloom.functions import similarity as S
from jobloom.functions import text as X


def register_functions(spark: SparkSession) -> list[str]:
    """Register the engine's functions; the native ones become SQL-defined functions.

    A SQL-defined function is inlined by the analyser, so it keeps code generation and
    costs no Python round trip.
    """
    def define(name: str, args: list[str], result: str, body) -> None:
        params = ", ".join(f"{a} STRING" for a in args)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")

    terms = "|".join(X.R.COMPANY_TERMS)
    word = X.WORD
    norm = (f"trim(regexp_replace(regexp_replace(trim(lower(coalesce(x, ''))), "
            f"r'(?<![{word}])(?:{terms})(?![{word}])', ' '), r'[^{word}]+', ' '))")
    define("posting_normalize", ["x"], "STRING", norm)

    def grams(v):
        return (f"array_distinct(flatten(transform(filter(split(lower(coalesce({v}, '')), "
                rf"r'[^\p{{L}}\p{{N}}]+'), w -> w != ''), "
                "w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))")
    define("posting_trigrams", ["x"], "ARRAY<STRING>", grams("x"))
    def overlap(a, b):
        # the lists are bound once as the fields of a struct
        return (f"element_at(transform(array(struct({a} AS x, {b} AS y)), p -> CASE WHEN size(array_union(p.x, p.y)) = 0 THEN 0D "
                "ELSE size(array_intersect(p.x, p.y)) / size(array_union(p.x, p.y)) END), 1)")

    define("trigram_similarity", ["a", "b"], "DOUBLE", overlap("posting_trigrams(a)", "posting_trigrams(b)"))

    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(trim(x)), '{n}')" for n in needles) + f" THEN '{province}'"
        for needles, province in X.R.PROVINCE_RULES)
    define("province_of", ["x"], "STRING", f"CASE {cases} ELSE '{X.R.UNKNOWN_LOCATION}' END")

    spark.udf.register("posting_seq_ratio", S.seq_ratio)
    define("posting_jaccard", ["a", "b"], "DOUBLE",
           overlap(*(f"filter(split({v}, ' '), w -> w != '')" for v in "ab")))
    define("posting_mixed", ["a", "b"], "DOUBLE", "CASE WHEN a = b THEN 1D WHEN a = '' OR b = '' THEN 0D "
           "WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(posting_jaccard(a, b), posting_seq_ratio(a, b)) END")
    define("posting_similarity", ["a", "b"], "DOUBLE", "posting_mixed(posting_normalize(a), posting_normalize(b))")
    return ["posting_normalize", "posting_trigrams", "trigram_similarity", "province_of",
            "posting_jaccard", "posting_seq_ratio", "posting_mixed", "posting_similarity"]
