"""Constant dimensions of the election model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Election types by id, with their category, kind and place.
ELECTION_TYPES = (
    (1, "predsjednicki", "Predsjednički izbori"),
    (2, "parlamentarni", "Parlamentarni izbori"),
    (3, "eu", "Izbori za Europski parlament"),
    (4, "gradsko-vijece", "Gradsko vijeće"),
    (5, "opcinsko-vijece", "Općinsko vijeće"),
    (6, "gradonacelnik", "Gradonačelnik"),
    (7, "nacelnik", "Načelnik"),
    (8, "zupan", "Župan"),
    (9, "zupanijska-skupstina", "Županijska skupština"),
)
PRESIDENT, PARLIAMENT, EUROPE = "Predsjednički izbori", "Parlamentarni izbori", "Izbori za Europski parlament"
# Categories with their label and types.
CATEGORIES = {
    "predsjednicki": ("Predsjednički", [PRESIDENT]),
    "sabor": ("Sabor", [PARLIAMENT]),
    "eu": ("EU parlament", [EUROPE]),
    "lokalni": (
        "Lokalni",
        [
            "Župan", "Županijska skupština", "Gradonačelnik", "Gradsko vijeće", "Načelnik", "Općinsko vijeće",
            "Zamjenik župana", "Zamjenik načelnika", "Zamjenik gradonačelnika", "Local",
        ],
    ),
}
# Fixed values.
#: Local types whose turnout counts in each round: a voter is in one of them.
CANONICAL_LOCAL = {1: ["Općinsko vijeće", "Gradsko vijeće"], 2: ["Načelnik", "Gradonačelnik"]}
# Fixed values.
#: kind -> municipality type -> election type, and kinds of county level.
LOCAL_KINDS = {
    "vijece": {"grad": "Gradsko vijeće", "općina": "Općinsko vijeće"},
    "nacelnik": {"grad": "Gradonačelnik", "općina": "Načelnik"},
}
COUNTY_KINDS = {"zupan": "Župan", "zup_skupstina": "Županijska skupština"}
KIND_OF_TYPE = {t: k for k, by in LOCAL_KINDS.items() for t in by.values()} | {t: k for k, t in COUNTY_KINDS.items()}

# Columns that name a row of another table and go with it.
FOREIGN_KEYS = {
    "municipality": {"county_id": "county"},
    "polling_station": {"municipality_id": "municipality"},
    "election": {"election_type_id": "election_type"},
    "election_round": {"election_id": "election"},
    "electoral_district": {"election_id": "election"},
    "electoral_list": {"election_round_id": "election_round", "district_id": "electoral_district"},
    "candidacy": {"person_id": "person", "electoral_list_id": "electoral_list"},
    "turnout": {"election_round_id": "election_round", "polling_station_id": "polling_station"},
    "list_result": {"electoral_list_id": "electoral_list", "polling_station_id": "polling_station"},
    "candidate_result": {"candidacy_id": "candidacy", "polling_station_id": "polling_station"},
}

# Fixed values of the seat rules.
STANDARD_SEATS, LEGACY_MINORITY_SEATS = 14, 8
SPECIAL_SEATS = {11: 3, 12: LEGACY_MINORITY_SEATS, 121: 3, 122: 1, 123: 1, 124: 1, 125: 1, 126: 1}
MINORITY_DISTRICTS = (121, 122, 123, 124, 125, 126)
MINORITY_GROUP = "NACIONALNE MANJINE"
MINORITY_DISTRICT_NAME = "XII. IZBORNA JEDINICA - NACIONALNE MANJINE"
THRESHOLD, PREFERENTIAL = 0.05, 0.10
EU_SEATS, EU_DEFAULT_SEATS = {2013: 12, 2014: 11, 2019: 12, 2024: 12}, 12
SEARCH_LIMIT, TOP_LIMIT, LEAST_DISTRICT_VOTES, LEAST_QUERY = 20, 5, 50, 2
ABROAD_FROM = "90"


def category_dimension(spark: SparkSession) -> DataFrame:
    rows = [(t, c, label) for c, (label, types) in CATEGORIES.items() for t in types]
    return spark.createDataFrame(rows, "type_name string, category string, category_label string")
