"""Fixed inventories: classes, bands, seasons, model settings, table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---- Fixed values: they must equal the published ones for right results ----

SCHEMA_VERSION = "five-class-19-band-v5-drop-summer"

CLASSES = [
    (0, "Vegetation", "#006400", "Trees, forest, plantations & other green cover"),
    (1, "Water", "#0000FF", "Lakes, rivers, ponds & water bodies"),
    (2, "Built Area", "#FF0000", "Built-up structures, concrete & urban infrastructure"),
    (3, "Open Land", "#D2B48C", "Bare rock, exposed soil & unvegetated open ground"),
    (4, "Agriculture", "#90EE90", "Cultivated fields, seasonal crops & fallow agricultural land"),
]

LEGACY_CLASS_NAMES = {
    "Forest": "Vegetation",
    "Buildings": "Built Area",
    "Barren Land": "Open Land",
    "Bare": "Open Land",
}

BANDS = [
    "B4", "B8", "B11", "B12", "NDVI", "NDWI", "SAVI", "UI", "IBI", "SWIRratio",
    "g_contrast", "g_var", "g_idm", "VV", "VH", "VVVH", "s_contrast", "s_var", "s_ent",
]
FULL_BANDS = [
    "B2", "B3", "B4", "B8", "B11", "B12", "NDVI", "NDWI", "NDBI", "SAVI",
    "BSI", "UI", "IBI", "SWIRratio", "BAEI",
    "g_contrast", "g_ent", "g_var", "g_idm", "g_diss", "g_asm",
    "VV", "VH", "VVVH", "s_contrast", "s_var", "s_ent",
]
STACK_CUTS = {
    "b27": [],
    "b22": ["B8", "NDVI", "NDWI", "NDBI", "s_ent"],
    "b19": ["B2", "B4", "B8", "NDVI", "NDWI", "NDBI", "SAVI", "s_ent"],
}
OPTICAL_BANDS = ["B2", "B3", "B4", "B8", "B11", "B12"]
RADAR_BANDS = ["VV", "VH"]
CAMPUS_BANDS = ["B2", "B3", "B4", "B8", "B11", "B12", "NDVI", "NDWI", "NDBI", "SAVI"]
BINARY_BANDS = ["B4", "B8", "NDVI"]

FEATURE_RANGES = {
    "SWIRratio": (0.0, 2.5),
    "BAEI": (0.0, 9.0),
    "g_contrast": (0.0, 22.0),
    "g_ent": (0.0, 4.2),
    "g_var": (0.0, 42.0),
    "g_diss": (0.0, 3.6),
    "s_contrast": (0.0, 13.5),
    "s_var": (0.0, 34.0),
    "s_ent": (0.0, 4.0),
}

SEASONS = {
    "winter": ("2025-01-01", "2025-03-01"),
    "summer": ("2025-04-01", "2025-05-30"),
}
SEASON_WINDOW_DAYS = 59
SWEEP_SEASONS = {
    "Early Summer": ("2025-03-01", "2025-04-30"),
    "Post-Monsoon": ("2025-09-01", "2025-10-31"),
    "Winter": ("2025-11-01", "2025-12-31"),
}
SWEEP_CLOUDS = [5, 10, 15, 20, 30, 50]

FALLBACK_WINDOW = ("2024-01-01", "2025-12-31")
FALLBACK_CLOUD = 30
DEFAULT_CLOUD = 15
CLOUD_BIT = 10
CIRRUS_BIT = 11
RADAR_MODE = "IW"
RADAR_PASS = "DESCENDING"

SOURCE_LABELS = {"forest": 0, "water": 1, "buildings": 2, "barren": 3, "agriculture": 4}
SOURCE_COUNTS = {"barren": 1000, "agriculture": 1000}

DEFAULT_MODEL = "gtb"
MODEL_ALIASES = {"xgb": "gtb"}
MODELS = {
    "rf": ("Random Forest", "Ensemble Trees",
           {"numberOfTrees": 300, "minLeafPopulation": 1, "bagFraction": 0.5, "maxNodes": None}),
    "svm": ("Support Vector Machine (SVM)", "Kernel-based Classifier",
            {"kernelType": "RBF", "gamma": 0.1, "cost": 10.0}),
    "gtb": ("Smile Gradient Tree Boosting (GTB)", "Gradient Boosting",
            {"numberOfTrees": 300, "shrinkage": 0.1, "maxNodes": 10}),
    "cart": ("Decision Tree (CART)", "Single Tree", {"maxNodes": 20}),
    "knn": ("K-Nearest Neighbors (KNN)", "Instance-based", {"k": 9}),
}
MODEL_BENCHMARKS = {
    "rf": (86.44827586206897, 71.84249628528974),
    "svm": (86.37931034482759, 68.61069836552748),
    "gtb": (87.41379310344828, 73.84843982169392),
    "cart": (80.55172413793103, 61.32986627043091),
    "knn": (85.27586206896551, 69.65081723625556),
}
SWEEP_MODELS = {
    "CART": ("cart", {"maxNodes": 10, "minLeafPopulation": 10}),
    "Random Forest": ("rf", {"numberOfTrees": 200, "minLeafPopulation": 1,
                             "bagFraction": 0.3, "maxNodes": 10}),
    "k-NN": ("knn", {"k": 5}),
    "SVM (RBF)": ("svm", {"kernelType": "RBF", "gamma": 1.0, "cost": 100.0}),
    "XGBoost": ("gtb", {"numberOfTrees": 200, "shrinkage": 0.05, "maxNodes": 5}),
}
TUNING_GRIDS = {
    "Random Forest": [{"n_estimators": [10, 50, 100, 150, 200, 300],
                       "min_samples_leaf": [1, 3, 5],
                       "max_samples": [0.1, 0.3, 0.5, 0.7, 0.9, None]}],
    "SVM": [{"kernel": ["rbf"], "gamma": [0.1, 0.5, 1.0], "C": [1, 10, 100]},
            {"kernel": ["linear"], "gamma": ["scale"], "C": [1, 10, 100]}],
    "XGBoost": [{"n_estimators": [10, 20, 50, 100],
                 "learning_rate": [0.01, 0.05, 0.1, 0.3],
                 "max_depth": [3, 5, 10]}],
}

PIXEL_AREA_SQM = 100.0
SQM_PER_HECTARE = 10000.0
SQM_PER_ACRE = 4046.856
EARTH_RADIUS_M = 6378137.0
METRES_PER_DEGREE = 111320.0
TILE_PX = 1792
EDGE_PAD_PX = 24
PREVIEW_PX = (256, 2048)
GREY_LEVELS = 32
PERFECT_SCORE = 0.9999

# ---- Derived ----

CLASS_IDS = [row[0] for row in CLASSES]
BAND_STACKS = {name: [b for b in FULL_BANDS if b not in cut] for name, cut in STACK_CUTS.items()}
BAND_STACKS["production"] = list(BANDS)


def band_stack(name: str) -> list[str]:
    """Ordered bands of a named stack; the list must be unique and known."""
    bands = BAND_STACKS[name]
    if len(set(bands)) != len(bands) or not set(bands) <= set(FULL_BANDS):
        raise ValueError(f"stack {name} repeats a band or leaves the full inventory")
    return list(bands)


def normalise_model(model: str) -> str:
    """Lower-case model id with retired spellings resolved."""
    key = model.lower()
    key = MODEL_ALIASES.get(key, key)
    if key not in MODELS:
        raise ValueError(f"Unsupported model: {model}")
    return key


# ---- Table schemas ----

SCENES = T.StructType([
    T.StructField("scene_id", T.LongType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("cloud_pct", T.DoubleType()),
    T.StructField("instrument_mode", T.StringType()),
    T.StructField("orbit_pass", T.StringType()),
    T.StructField("polarisations", T.ArrayType(T.StringType())),
])
SWEEP = T.StructType([
    T.StructField("season", T.StringType()),
    T.StructField("cloud_cover", T.IntegerType()),
    T.StructField("classifier", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("kappa", T.DoubleType()),
    T.StructField("confusion_matrix", T.StringType()),
    T.StructField("image_count", T.LongType()),
])


# ---- Dimension tables: a handful of rows each, fixed by the lists above ----

def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id int, name string, color string, description string")


def model_table(spark: SparkSession) -> DataFrame:
    rows = [
        (mid, name, kind, {k: str(v) for k, v in params.items() if v is not None},
         *MODEL_BENCHMARKS[mid], SCHEMA_VERSION)
        for mid, (name, kind, params) in MODELS.items()
    ]
    return spark.createDataFrame(
        rows,
        "model_id string, model_name string, model_type string, params map<string,string>, "
        "winter_pct double, summer_pct double, schema_version string",
    )


def season_table(spark: SparkSession, seasons: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    rows = [(i, name, *window) for i, (name, window) in enumerate((seasons or SEASONS).items())]
    return spark.createDataFrame(
        rows, "ordinal int, season string, start_text string, end_text string"
    ).selectExpr("ordinal", "season", "CAST(start_text AS DATE) AS start_date", "CAST(end_text AS DATE) AS end_date")


def source_table(spark: SparkSession) -> DataFrame:
    rows = [(name, label, SOURCE_COUNTS.get(name)) for name, label in SOURCE_LABELS.items()]
    return spark.createDataFrame(rows, "source string, expected_label int, expected_count long")
