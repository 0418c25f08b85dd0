"""The vocabularies and limits that results must agree on."""

from __future__ import annotations

# Weekdays in calendar order, and the texts accepted for each. There is no Sunday collection.
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT")
DAY_NAMES = {
    "MON": "MON", "MONDAY": "MON",
    "TUE": "TUE", "TUES": "TUE", "TUESDAY": "TUE",
    "WED": "WED", "WEDNESDAY": "WED",
    "THU": "THU", "THUR": "THU", "THURS": "THU", "THURSDAY": "THU",
    "FRI": "FRI", "FRIDAY": "FRI",
    "SAT": "SAT", "SATURDAY": "SAT",
}

# Collection types in order, with their source fields.
TYPES = ("REFUSE", "RECYCLING", "ORGANICS", "BULK")
TYPE_FIELDS = {t: f"FREQ_{t}" for t in TYPES}

# Schedule states, and the rule by which organics follow recycling.
EXPLICIT, DERIVED, BLANK, NO_SERVICE = "SOURCE_EXPLICIT", "POLICY_DERIVED", "UNKNOWN_SOURCE_BLANK", "NO_SERVICE"
STATES = (EXPLICIT, DERIVED, BLANK, NO_SERVICE)
ORGANICS_RULE = "dsny-organics-on-recycling-day-v1"
POLICY_REVIEWED, POLICY_WARN_DAYS, POLICY_BLOCK_DAYS = "2026-08-21", 180, 365

# Boroughs by code, and the codes of segments and features in scope.
BOROUGHS = {1: "MANHATTAN", 2: "BRONX", 3: "BROOKLYN", 4: "QUEENS", 5: "STATEN ISLAND"}
SEGMENT_TYPES = ("B", "G", "E", "F", "U")
FEATURE_TYPES = ("0", "6", "C", "W", "A", "F")

# Outcomes of sides, source rows and polygons.
SIDE_OUTCOMES = ("matched", "out_of_scope", "deduplicated_alias", "non_addressable", "outside_schedule_area", "partially_outside_schedule_area", "ambiguous", "invalid", "conflicts")
FATAL_OUTCOMES = ("ambiguous", "invalid", "conflicts")
POLYGON_OUTCOMES = ("used_valid", "unused_valid", "invalid")

# Geometry limits in feet.
OFFSET_FEET, LEAST_OFFSET_FEET, TOLERANCE_FEET, LEAST_OVERLAP_FEET = 25.0, 0.25, 1.0, 0.25
COVER_TOLERANCE_FEET, TRIM_SHARE, REVERSAL_COSINE = 1e-5, 0.25, -0.95

# Tiles and gates.
MIN_ZOOM, MAX_ZOOM, UNKNOWN_ZOOM, EXTENT, TILE_BUFFER_PIXELS = 12, 17, 16, 4096, 16
MAX_TILE_BYTES, MAX_RAW_TILE_BYTES = 512_000, 5_242_880
STREET_CAP = 20_000
FLOORS = {"raw_lion_rows": 200_000, "dsny_frequency_rows": 500, "output_features": 100_000}
MAX_DROP = 0.10
VERSION_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
