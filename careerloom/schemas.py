"""Schemas, key columns and constants of the engine.

Codes are always strings, never numbers: a numeric code loses its leading zeros.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Thresholds, protocol sizes and grids that results depend on.
CORE_AT_LEAST = 4.0
IRRELEVANT_AT_MOST = 1.0
HOLDOUT = 0.10
FOLDS = 5
SEED = 42
BOOTSTRAP = 2000
CALIBRATION_BINS = 10
MIN_GROUP_REGRESSION = 20
MIN_GROUP_CLASSIFICATION = 8
CODE_WIDTH = 5

#: Five outlook conditions and the three classes they recode to.
OUTLOOK_CLASSES = {
    "Strong risk of Shortage": "shortage",
    "Moderate risk of Shortage": "shortage",
    "Balance": "balance",
    "Moderate risk of Surplus": "surplus",
    "Strong risk of Surplus": "surplus",
}

RATING_FACT = T.StructType(
    [
        T.StructField("occupation_id", T.IntegerType()),
        T.StructField("oasis_code", T.StringType()),
        T.StructField("noc_code", T.StringType()),
        T.StructField("occupation_name", T.StringType()),
        T.StructField("descriptor_id", T.IntegerType()),
        T.StructField("descriptor_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("rating", T.DoubleType()),
    ]
)

POSTINGS = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("job_title", "noc21_code", "noc21_name", "province", "city", "education", "experience", "employment_type", "employment_term", "industry")],
        T.StructField("salary_annual", T.DoubleType()),
        T.StructField("posting_date", T.StringType()),
        T.StructField("source_month", T.StringType()),
        T.StructField("vacancies", T.IntegerType()),
    ]
)

OUTLOOK = T.StructType([T.StructField("noc_code", T.StringType()), T.StructField("occupation_name", T.StringType()), T.StructField("future_conditions", T.StringType()), T.StructField("employment_growth", T.DoubleType())])

SKILL_TAGS = T.StructType([T.StructField("job_link", T.StringType()), T.StructField("skill_clean", T.StringType())])
