"""The normalized notice table and the closed vocabularies of its columns."""

from __future__ import annotations

from pyspark.sql import types as T

CATEGORIES = ("allergen", "pathogen", "foreignMaterial", "mislabeling", "contaminant", "other")
CLASSES = ("Class I", "Class II", "Class III", "Public Health Alert", "Product Recall", "Allergy Alert", "Food Alert for Action")
SOURCES = ("fda", "usda", "uk", "ncc", "woolworths", "shoprite", "nrcs", "cfia", "rasff")
COUNTRIES = ("us", "uk", "za", "ca", "eu")
COUNTRY_SOURCES = {"us": ("fda", "usda"), "uk": ("uk",), "za": ("ncc", "woolworths", "shoprite", "nrcs"), "ca": ("cfia",), "eu": ("rasff",)}
ENTITY_TYPES = ("allergen", "pathogen", "hazard", "contaminant")
#: From worst to mildest.
SEVERITIES = ("critical", "severe", "high", "moderate", "low")
SORTS = ("recency", "severity", "novelty")
TREND_GROUPS = ("total", "category", "source", "severity", "classification")

ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])

NOTICE = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("source", T.StringType()), ("country", T.StringType()), ("recall_number", T.StringType()), ("source_url", T.StringType()),
            ("event_id", T.StringType()), ("status", T.StringType()), ("classification", T.StringType()), ("product_description", T.StringType()),
            ("reason_text", T.StringType()), ("company_name", T.StringType()), ("state", T.StringType()), ("states", T.ArrayType(T.StringType())),
            ("notifying_country", T.StringType()), ("origin_countries", T.ArrayType(T.StringType())), ("distribution_countries", T.ArrayType(T.StringType())),
            ("distribution_pattern", T.StringType()), ("recall_initiation_date", T.DateType()), ("report_date", T.DateType()),
            ("category", T.StringType()), ("category_confidence", T.DoubleType()), ("severity_score", T.DoubleType()), ("severity_label", T.StringType()),
            ("entities", T.ArrayType(ENTITY)), ("raw", T.StringType()),
        )
    ]
)

KEY = ["source", "recall_number"]
