"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES — kept verbatim, in their natural order, in one place.
"""

# FIXED VALUES: soaId letter prefix -> section name (40 entries).
SECTION_MAP = {
    "AS": "Animal Stewardship",
    "BH": "Biodiversity & Habitat",
    "BP": "Biodiversity Protection",
    "CC": "Carbon Credits",
    "CE": "Carbon Emissions",
    "CF": "Conservation Finance",
    "CM": "Crop Management",
    "CO": "Conservation",
    "CT": "Conservation Tillage",
    "FM": "Farm Management",
    "HA": "Habitat",
    "HH": "Habitat & Hydrology",
    "HP": "Habitat Protection",
    "HS": "Habitat Stewardship",
    "HW": "Habitat Water",
    "IO": "Integrated Organisms",
    "LM": "Land Management",
    "NM": "Nutrient Management",
    "OE": "Organic - Energy",
    "OF": "Organic Farming",
    "OM": "Organic Matter",
    "OP": "Organic Production",
    "OR": "Organic Resources",
    "OS": "Organic Stewardship",
    "OT": "Organic Tillage",
    "OW": "Organic Water",
    "PM": "Pest Management",
    "PS": "Pest Stewardship",
    "RI": "Risk Indicators",
    "RM": "Risk Management",
    "SC": "Soil Carbon",
    "SF": "Soil Fertility",
    "SM": "Soil Management",
    "SR": "Soil Resilience",
    "ST": "Seed Treatment",
    "SW": "Soil Water",
    "WI": "Water Irrigation",
    "WP": "Water Protection",
    "WQ": "Water Quality",
    "WS": "Water Stewardship",
}
DEFAULT_SECTION = "General"

# FIXED VALUES: default crop synonym overrides (local name -> canonical).
CROP_SYNONYMS = {
    "ARROZ": "Rice",
    "AGUACATE": "Avocado",
    "AVENA": "Oats",
    "Aardappelen": "Potato",
    "Tarwe": "Wheat",
    "Weizen": "Wheat",
    "Mais": "Corn",
    "Kartoffeln": "Potato",
    "Wintergerste": "Barley",
    "Sonnenblume": "Sunflower",
    "Soja": "Soybeans",
    "Orzo": "Barley",
    "Erba Medica": "Alfalfa",
    "Frumento (Wheat)": "Wheat",
    "rijst": "Rice",
    "Pepino": "Cucumber",
    "Tomate": "Tomato",
}

# FIXED VALUES: input header aliases -> canonical column names.
COLUMN_ALIASES = {
    "Partner": "partner",
    "Crop": "crop_name",
    "Country": "country_code",
    "PlanYear": "planYear",
    "plan_year": "planYear",
}

# FIXED VALUES: profile feature columns, in order.
FEATURE_COLUMNS = [
    "country_code",
    "crop_name",
    "partner",
    "subpartner",
    "irrigation",
    "hired_workers",
    "area",
    "planYear",
]
NUMERIC_COLUMNS = ["hired_workers", "area", "planYear"]
CATEGORY_COLUMNS = ["country_code", "crop_name", "partner", "subpartner", "irrigation"]
# Interaction terms, in the order they are appended to the feature list.
INTERACTIONS = [
    ("crop_country", "crop_name", "country_code"),
    ("crop_partner", "crop_name", "partner"),
    ("country_partner", "country_code", "partner"),
]
UNKNOWN = "Unknown"

# FIXED VALUES: answers treated as blank when deriving question metadata.
BLANK_ANSWERS = ["", "null", "None"]
# White space of any script at either end of a text.
STRIP = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
# Distinct answers up to which a question's model is scored by dense vectors (every trainable one has a model).
MAX_CLASSES = 75
# FIXED VALUES: the boolean-like answer set (options become False/True).
BOOLEAN_ANSWERS = ["True", "False", "true", "false", "1", "0"]
BOOLEAN_OPTIONS = ["False", "True"]

# FIXED VALUES: type-inference limits.
MAX_NUMERIC_OPTIONS = 75
MAX_TEXT_OPTIONS = 50
CHECKBOX_MIN_OPTIONS = 7      # more than 6 distinct texts -> checkbox
CHECKBOX_MIN_AVG_LEN = 40.0   # average length above 40 -> checkbox

# FIXED VALUES: training thresholds.
MIN_TRAINING_SAMPLES = 20
MIN_TRAINING_SAMPLES_V1 = 10
SPLIT_MIN_ROWS = 50
STRATIFY_MAX_CLASSES = 20
CV_MIN_ROWS = 100
CV_MAX_FOLDS = 5
TEST_FRACTION_FOLDS = 5       # 1 of 5 ordered slots -> 20 % holdout

# FIXED VALUES: tree-ensemble parameters.
TREE_PARAMS = {
    "max_depth": 5,
    "n_estimators": 200,
    "learning_rate": 0.05,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "random_state": 42,
}
HYPERPARAM_GRID = {
    "max_depth": [3, 5, 7],
    "n_estimators": [100, 200, 300],
    "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.7, 0.8, 1.0],
}
GRID_SEARCH_MIN_ROWS = 500

# FIXED VALUES: confidence policy thresholds (v2) and the v1 high-confidence cut.
AUTO_FILL_THRESHOLD = 70.0
SUGGEST_THRESHOLD = 40.0
HIGH_CONFIDENCE_THRESHOLD = 80.0

# FIXED VALUES: sustainability score bands (lower bound, band, colour).
SCORE_BANDS = [
    (80.0, "Excellent", "green"),
    (60.0, "Good", "amber"),
    (40.0, "Needs Improvement", "orange"),
    (None, "Poor", "red"),
]
AMBER_SCORE_FACTOR = 0.6
SCORE_RANGE_HALF_WIDTH = 7
MINUTES_PER_AUTO_FILL = 0.5

# FIXED VALUES: feedback / explanation / neighbour limits.
MIN_CORRECTIONS = 10
TOP_DRIVERS = 5
REASON_DRIVERS = 3
MIN_IMPACT = 0.01
DEFAULT_NEIGHBOURS = 5
MAX_NEIGHBOURS = 20
HISTORY_LIMIT = 50
TOP_CROPS = 5
TOP_CORRECTED = 10

# FIXED VALUES: labels written into predictions.
SOURCE_MODEL = "count_model_v1"
SOURCE_NO_MODEL = "no_model"
MANUAL_REASON = "Open {type} field — AI cannot predict free-form input"
