"""Preparation of the named datasets: scan, clean, label, split, and a scaler fitted on part T.

Each dataset is a declaration; one function carries all of them out. Features stay unscaled in
``rows`` (trees read them as they are); ``scaled()`` applies the scaler.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demur.functions import text as tx
from demur.operators import prep
from demur.operators import split as sp
from demur.session import settle
from demur.sources import scan, synth

# Column names, value codes, patterns and parameters of the datasets.
LISTING_COLUMNS = [
    "host_response_time", "host_response_rate", "host_is_superhost", "host_total_listings_count",
    "host_identity_verified", "latitude", "longitude", "property_type", "room_type", "accommodates",
    "bathrooms", "bathroom_type", "bedrooms", "beds", "number_of_reviews", "review_scores_rating",
    "review_scores_checkin", "review_scores_communication", "review_scores_location", "minimum_nights",
    "maximum_nights", "availability_30", "price",
]
LISTING_ONEHOT = ["property_type", "room_type", "bathroom_type"]
LISTING_FLAGS = ["host_is_superhost", "host_identity_verified"]
LISTING_PRICE_LIMIT = 300
COVER_NUMERIC = [
    "Elevation", "Aspect", "Slope", "Horizontal_Distance_To_Hydrology", "Vertical_Distance_To_Hydrology",
    "Horizontal_Distance_To_Roadways", "Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm",
    "Horizontal_Distance_To_Fire_Points",
]
NO_YES = {"No": 0, "Yes": 1}
SERVICE = {"No internet service": 0, "No": 1, "Yes": 2}
CHURN_CODES = {
    "gender": {"Male": 0, "Female": 1},
    "Partner": NO_YES,
    "Dependents": NO_YES,
    "PhoneService": NO_YES,
    "PaperlessBilling": NO_YES,
    "Churn": NO_YES,
    "MultipleLines": {"No phone service": 0, "No": 1, "Yes": 2},
    "OnlineSecurity": SERVICE,
    "OnlineBackup": SERVICE,
    "DeviceProtection": SERVICE,
    "TechSupport": SERVICE,
    "StreamingTV": SERVICE,
    "StreamingMovies": SERVICE,
    "InternetService": {"No": 0, "DSL": 1, "Fiber optic": 2},
    "Contract": {"Month-to-month": 0, "One year": 1, "Two year": 2},
    "PaymentMethod": {
        "Credit card (automatic)": 0, "Bank transfer (automatic)": 1, "Mailed check": 2, "Electronic check": 3,
    },
}
ADULT_CATEGORICAL = [
    "workclass", "education", "marital-status", "occupation", "relationship", "race", "sex", "native-country",
]
ADULT_NUMERIC = ["age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week"]
GAMMA_COLUMNS = [
    "fLength", "fWidth", "fSize", "fConc", "fConc1", "fAsym", "fM3Long", "fM3Trans", "fAlpha", "fDist", "class",
]
MARKETING_NUMERIC = [
    "age", "duration", "campaign", "pdays", "previous", "emp.var.rate", "cons.price.idx", "cons.conf.idx",
    "euribor3m", "nr.employed",
]
CREDIT_TARGET = "default payment next month"
FAILURE_FLAGS = ["TWF", "HDF", "PWF", "OSF"]
MACHINE_TYPES = ["L", "M", "H"]
SHAPES: dict[str, Callable] = {
    "twomoons": lambda ids, seed: synth.two_moons(ids, 0.22, seed),
    "circles": lambda ids, seed: synth.circles(ids, 0.1, 0.5, seed),
    "blobs": lambda ids, seed: synth.blobs(ids, [[5, 9], [7, 4], [6, 6]], 0.4, seed),
    "varied": lambda ids, seed: synth.blobs(ids, [[0, 10], [2, 1], [6, 8]], [1.5, 2.5, 0.7], seed),
    "aniso": lambda ids, seed: synth.affine_project(
        synth.blobs(ids, [[10, 9], [2, 1], [5, 10]], 0.9, seed), [[-0.6, 0.5], [0.5, -0.2]]
    ),
}
SHAPE_POINTS = {"twomoons": 10_000, "circles": 10_000, "blobs": 4_500, "varied": 4_500, "aniso": 4_500}


@dataclass
class Prepared:
    """Rows ``row_id, y, split, features`` with the scaler of part T."""

    rows: DataFrame
    features: list[str]
    scaler: prep.Scaler
    oversampled: bool = False
    seed: int = 42

    def scaled(self) -> DataFrame:
        return self.scaler.apply(self.rows)

    def part(self, name: str, scaled: bool = False) -> DataFrame:
        return (self.scaled() if scaled else self.rows).where(F.col("split") == name)

    def train(self, scaled: bool = False) -> DataFrame:
        """Part T, with the smaller classes repeated where the dataset asks for it."""
        rows = self.part("T", scaled)
        return sp.oversample(rows, self.seed).drop("copy") if self.oversampled else rows


@dataclass
class Spec:
    """``clean`` gives a table with ``y`` and the features; the flags say what follows."""

    read: Callable[[SparkSession, str], DataFrame]
    clean: Callable[[DataFrame], DataFrame]
    stratified: bool = True
    scale: Callable[[list[str]], list[str]] = field(default=lambda features: features)
    onehot: list[str] = field(default_factory=list)
    oversampled: bool = False
    sample: float | None = None


def _target(df: DataFrame, column: str, label) -> DataFrame:
    return df.withColumn("y", label).drop(column)


def _clean_listing(df: DataFrame) -> DataFrame:
    text = F.col("bathrooms_text")
    df = df.withColumns({"bathrooms": tx.bathroom_count(text), "bathroom_type": tx.bathroom_type(text)})
    df = prep.drop_null_rows(prep.project(df, ["row_id", *LISTING_COLUMNS]))
    df = df.withColumns(
        {
            "host_response_rate": tx.parse_percent(F.col("host_response_rate")),
            "host_response_time": prep.encode_ordinal(F.col("host_response_time"), list(tx.RESPONSE_TIMES)),
            "property_type": tx.bucket_property(F.col("property_type")),
            **{c: prep.encode_flag(F.col(c).cast("string")).cast("int") for c in LISTING_FLAGS},
        }
    )
    return _target(df, "price", prep.binary_target(tx.parse_money(F.col("price")) > LISTING_PRICE_LIMIT))


def _clean_churn(df: DataFrame) -> DataFrame:
    df = prep.fill_constant(df.withColumn("TotalCharges", F.col("TotalCharges").cast("string").try_cast("double")), ["TotalCharges"])
    df = prep.encode_dict(df, {c: m for c, m in CHURN_CODES.items() if c in df.columns})
    coded = {c: F.col(c).try_cast("int") for c in CHURN_CODES if c in df.columns}
    return df.withColumns(coded).withColumnRenamed("Churn", "y")


def _clean_adult(df: DataFrame) -> DataFrame:
    df = prep.drop_null_rows(prep.sentinel_to_null(df))
    df = _target(df, "target", prep.binary_target(F.trim("target") == ">50K"))
    return _encode_all(df, ADULT_CATEGORICAL)


def _clean_marketing(df: DataFrame) -> DataFrame:
    df = df.withColumn("y", prep.binary_target(F.col("y") == "yes"))
    return _encode_all(df, prep.select_by_type(df, ["row_id", "y"])[0])


def _encode_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """Label codes for several columns; the codes are found on all rows."""
    for c in columns:
        df = prep.encode_label(df.withColumnRenamed(c, "_raw"), "_raw", c).drop("_raw")
    return df


def _clean_machines(df: DataFrame) -> DataFrame:
    df = df.withColumn("y", prep.flags_to_label(FAILURE_FLAGS)).where("y is not null")
    return df.withColumn("Type", prep.encode_ordinal(F.col("Type"), MACHINE_TYPES)).drop("UDI", "Product ID")


def _header(spark: SparkSession, path: str) -> DataFrame:
    return scan.scan_csv(spark, path)


def _semicolon(spark: SparkSession, path: str) -> DataFrame:
    return scan.scan_delimited(spark, path, ";")


def _credit(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).head(2)
    names = [c.strip() for c in lines[1][0].split(",")]
    return scan.cast_all(scan.scan_header_offset(spark, path, names), "double")


SPECS: dict[str, Spec] = {
    "covid": Spec(_header, lambda d: d.withColumnRenamed("severity", "y"), stratified=False, scale=lambda f: f[1:]),
    "airbnb": Spec(
        _header,
        _clean_listing,
        stratified=False,
        scale=lambda f: [c for c in LISTING_COLUMNS if c in f and c not in LISTING_FLAGS],
        onehot=LISTING_ONEHOT,
    ),
    "heloc": Spec(
        _header, lambda d: _target(d, "RiskPerformance", prep.encode_ordinal(F.col("RiskPerformance"), ["Bad", "Good"])), stratified=False
    ),
    "covertype": Spec(
        _header,
        lambda d: _target(d, "Cover_Type", prep.shift_label(F.col("Cover_Type").cast("int"))),
        scale=lambda f: [c for c in COVER_NUMERIC if c in f],
        sample=0.1,
    ),
    "churn": Spec(_header, _clean_churn, oversampled=True),
    "adult": Spec(_header, _clean_adult, scale=lambda f: [c for c in ADULT_NUMERIC if c in f]),
    "magic_gamma": Spec(
        lambda s, p: scan.scan_headerless(s, p, ",", "string", GAMMA_COLUMNS),
        lambda d: scan.cast_all(
            _target(d, "class", prep.binary_target(F.trim("class") == "g")), "double", GAMMA_COLUMNS[:-1]
        ),
    ),
    "credit": Spec(
        _credit, lambda d: _target(d.drop("ID"), CREDIT_TARGET, F.col(CREDIT_TARGET).cast("int")), oversampled=True
    ),
    "marketing": Spec(
        _semicolon, _clean_marketing, scale=lambda f: [c for c in MARKETING_NUMERIC if c in f], oversampled=True
    ),
    "qsar": Spec(
        _semicolon, lambda d: _target(d, "experimental class", prep.binary_target(F.col("`experimental class`") == "RB"))
    ),
    "drive": Spec(
        lambda s, p: scan.scan_headerless(s, p, " "), lambda d: d.withColumn("y", prep.shift_label(F.col("y").cast("int")))
    ),
    "ai4i": Spec(_header, _clean_machines),
}


def load_raw(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The scanned table with a row id; written once, so that the ids stay the same for all passes."""
    if name not in SPECS:
        raise ValueError(f"unknown dataset {name!r}")
    df = prep.trim_column_names(SPECS[name].read(spark, path))
    return settle(df.withColumn("row_id", F.monotonically_increasing_id()), f"raw-{name}")


def prepare(df: DataFrame, name: str, seed: int) -> Prepared:
    """Cleans, labels and splits a raw table with ``row_id``."""
    spec = SPECS[name]
    rows = settle(spec.clean(df), f"clean-{name}")
    if spec.sample:
        rows = settle(sp.sample_stratified(rows, spec.sample, seed), f"sample-{name}")
    # the cardinality rule looks at the raw values, before codes replace them
    scale_rule = spec.scale
    if name == "churn":
        features = [c for c in df.columns if c not in ("row_id", "Churn")]
        kinds = prep.type_by_cardinality(df, features)
        scale_rule = lambda f: [c for c in f if kinds.get(c) == "continuous" and dict(rows.dtypes)[c] != "string"]
    parts = sp.split_stratified_four_way(rows, seed) if spec.stratified else sp.split_four_way(rows, seed)
    parts = settle(parts, f"parts-{name}")
    if spec.onehot:
        parts = prep.OneHot.fit(parts.where("split = 'T'"), spec.onehot).apply(parts)
    features = [c for c in parts.columns if c not in ("row_id", "y", "split")]
    scaler = prep.Scaler.fit(parts.where("split = 'T'"), scale_rule(features))
    return Prepared(parts, features, scaler, spec.oversampled, seed)


def prepare_shape(spark: SparkSession, name: str, seed: int, n: int | None = None) -> Prepared:
    """One of the synthetic shapes."""
    if name not in SHAPES:
        raise ValueError(f"unknown shape {name!r}")
    ids = spark.range(n or SHAPE_POINTS[name]).withColumnRenamed("id", "row_id")
    rows = sp.split_four_way(SHAPES[name](ids, seed).withColumnRenamed("label", "y"), seed)
    rows = settle(rows, f"shape-{name}")
    return Prepared(rows, ["x0", "x1"], prep.Scaler.fit(rows.where("split = 'T'"), ["x0", "x1"]), seed=seed)


def get_data(spark: SparkSession, name: str, path: str | None = None, seed: int = 42) -> Prepared:
    """Prepared data of a named set; the file sets need a path."""
    if name in SHAPES:
        return prepare_shape(spark, name, seed)
    return prepare(load_raw(spark, name, path), name, seed)
