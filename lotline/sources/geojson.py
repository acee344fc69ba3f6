"""Feature collections in and out.

Rows have the shape ``(ord, geometry STRING, properties_raw STRING, properties VARIANT)``.
``ord`` orders rows as the input does; every "first" in this library is the lowest ``ord``.

Three text layouts can be read:

``document``  any valid collection. One JSON document cannot be split, so each file is one
              task: right for small files and for one-off ingestion into Parquet.
``lines``     features on lines of their own, bare (newline-delimited) or inside a collection, which
              is what most exporters and :func:`write_features` write. Several on a line, the frame
              on the same line and a whole collection on one line are read too. Splits at line ends;
              a feature over several lines is an error.
``compact``   a collection on one line whose features all start with ``{"type":"Feature",``.
              That text is the record separator, so this splits too. It must not occur
              inside a property bag. Features that start otherwise are an error.

What is used more than once is best brought into a table first (:func:`ingest_features`) and read
with the layout ``parquet``.

Duplicate keys inside one property object raise an error, since it is not clear which counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotline.functions.geo import round_geometry

_FEATURE = "struct<type:string,geometry:string,properties:string>"
_COMPACT_START = '{"type":"Feature",'


def read_features(spark: SparkSession, path: str | list[str], layout: str = "document") -> DataFrame:
    if layout == "document":
        features = _read_documents(spark, path)
    elif layout == "lines":
        features = _read_lines(spark, path)
    elif layout == "compact":
        features = _read_compact(spark, path)
    elif layout == "parquet":
        features = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        raise ValueError(f"Unknown layout {layout!r}: expected document, lines, compact or parquet")
    return with_bag(features)


def ingest_features(spark: SparkSession, source: str | list[str], table: str, layout: str = "lines") -> None:
    """Write a feature collection as a table of ``(ord, geometry, properties_raw)``."""
    read_features(spark, source, layout).drop("properties").write.mode("overwrite").parquet(table)


def has_bag() -> Column:
    """Whether the feature has properties, told from the text without parsing it."""
    return F.startswith(F.ltrim("properties_raw"), F.lit("{"))


def with_bag(features: DataFrame) -> DataFrame:
    """Add the parsed property bag; null features and bags give a NULL bag."""
    bag = F.when(has_bag(), F.parse_json("properties_raw"))
    return features.select("ord", "geometry", "properties_raw", bag.alias("properties"))


def _read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    documents = (
        spark.read.schema(f"type string, features array<{_FEATURE}>")
        .options(multiLine=True, mode="FAILFAST")
        .json(paths)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    checked = documents.select(
        "file",
        F.when(
            (F.col("type") == "FeatureCollection") & F.col("features").isNotNull(),
            F.col("features"),
        )
        .otherwise(F.raise_error(F.concat(F.lit("Not a feature collection: "), "file")))
        .alias("features"),
    )
    return checked.select("file", F.posexplode("features").alias("pos", "f")).select(
        F.struct("file", F.lit(0).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("row")).alias("ord"),
        "f.geometry",
        F.col("f.properties").alias("properties_raw"),
    )


def _text_ord() -> Column:
    # Within one split, monotonically_increasing_id grows in reading order.
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _parsed(records: DataFrame, text: Column) -> DataFrame:
    """The features of each record's text, a comma-separated list; whatever is not a feature is an error."""
    entry = f"struct<type:string,geometry:string,properties:string,features:array<{_FEATURE}>>"
    # As an array, so that text after the first value is parsed too.
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{entry}>", {"mode": "FAILFAST"})
    entries = records.select("ord", F.posexplode(listed).alias("pos", "e"))
    own = F.struct(F.col("e.type").alias("type"), F.col("e.geometry").alias("geometry"), F.col("e.properties").alias("properties"))
    is_feature = F.col("e").isNull() | (F.col("e.type") == "Feature")
    wrong = F.raise_error(F.concat(F.lit("Neither a feature nor a collection: "), F.substring(F.to_json("e"), 1, 200)))
    features = (
        F.when(is_feature, F.array(own))
        .when((F.col("e.type") == "FeatureCollection") & F.col("e.features").isNotNull(), F.col("e.features"))
        .otherwise(F.from_json(wrong.cast("string"), f"array<{_FEATURE}>"))
    )
    rows = entries.select("ord", "pos", F.posexplode(features).alias("inner", "f"))
    place = F.struct("ord.file", "ord.block", "ord.row", F.col("pos").alias("entry"), F.col("inner").alias("feature"))
    return rows.select(place.alias("ord"), "f.geometry", F.col("f.properties").alias("properties_raw"))


# A collection's start up to its first feature, on a line of its own or with what follows.
_OPENING = r'^(\{\s*)?("(?!features")[^"]*"\s*:\s*("[^"]*"|\{[^{}]*(\{[^{}]*\}[^{}]*)*\}|[^{}\[\]",]*|\[[^\[\]]*\])\s*,\s*)*"features"\s*:\s*\['
# Its end: the closing bracket, further members, the closing brace.
_CLOSING = r'(^|(?<=[}l,])|(?<=[}l,]\s))\s*\]\s*(,\s*"(?!geometry"|properties"|coordinates"|bbox")[^"]*"\s*:\s*("[^"]*"|\{[^{}]*(\{[^{}]*\}[^{}]*)*\}|[^{}\[\]",]*)\s*)*\}?\s*$'
# Lines that belong to the collection alone.
_MEMBER = r'("type"\s*:\s*"FeatureCollection"|"(?!type"|geometry"|properties"|coordinates"|geometries"|features")[^"]*"\s*:\s*("[^"]*"|\{[^{}]*(\{[^{}]*\}[^{}]*)*\}|\[[^\[\]{}]*\]|[^{}\[\]"]*))'
_FRAME = rf"^(\{{?\s*({_MEMBER}(\s*,\s*{_MEMBER})*)?|\[|\]?\s*\}}?)$"


# How a feature on a line of its own starts, as most writers put it.
_FEATURE_STARTS = ('{"type":"Feature"', '{"type": "Feature"')


def _read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each line holds features, separated by commas, or the collection's frame, or both, or a whole collection."""
    value = F.col("value")
    starts = F.startswith(value, F.lit(_FEATURE_STARTS[0])) | F.startswith(value, F.lit(_FEATURE_STARTS[1]))
    ends, ends_by_comma = F.endswith(value, F.lit("}")), F.endswith(value, F.lit("},"))
    # Neither a collection's start nor its end can be on such a line, so that there is nothing to take off.
    unframed = ~F.contains(value, F.lit("]")) | ~(F.contains(value, F.lit('"features"')) | value.rlike(r"[}l,]\s*\]"))
    plain = starts & (ends | ends_by_comma) & unframed
    own = F.when(ends, value).otherwise(F.left(value, F.length(value) - F.lit(1)))
    # No filter on empty texts: it would compute them twice, and they have no features to explode.
    text = F.when(plain, own).otherwise(_without_frame(value))
    return _parsed(spark.read.text(path).select(_text_ord().alias("ord"), text.alias("text")), F.col("text"))


def _without_frame(value: Column) -> Column:
    """A line without what it has of the collection's frame."""

    def unframed(bare: Column) -> Column:
        # A line that is JSON as it stands is left so; else a frame may begin or end on it.
        whole = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))).isNotNull()
        inner = F.regexp_replace(F.regexp_replace(bare, _OPENING, ""), _CLOSING, "")
        framed = F.regexp_replace(inner, r"^\s*,?\s*|\s*,?\s*$", "")
        return F.when(whole, bare).when(bare.rlike(_FRAME), "").otherwise(framed)

    line = F.regexp_replace(value, "^[\\s\ufeff]+|\\s+$", "")
    # As an array's only element, so that it is computed once.
    return F.get(F.transform(F.array(F.regexp_replace(line, r"^,\s*|\s*,$", "")), unframed), F.lit(0))


def _read_compact(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every feature starts with the separator; a file with a feature that does not is refused."""
    pieces = spark.read.text(path, lineSep=_COMPACT_START).select(_text_ord().alias("ord"), "value")
    other = F.raise_error(F.concat(F.lit(f"Features must all start with {_COMPACT_START}; use another layout for "), "ord.file"))
    # A piece is a feature without its start, then a comma or the collection's end.
    tail = F.regexp_replace("value", r"\}\s*(,\s*|\]\s*(,\s*\"[^{}]*)?\}?\s*)$", "}")
    is_piece = F.col("value").rlike(r'^\s*"')
    is_start = ~F.col("value").rlike(r'"type"\s*:\s*"Feature"|\[\s*null')
    text = F.when(is_piece, F.concat(F.lit(_COMPACT_START), tail)).when(is_start, "").otherwise(other.cast("string"))
    return _parsed(pieces.select("ord", text.alias("text")).filter("text <> ''"), F.col("text"))


# --- sink ---------------------------------------------------------------------------------

# The members of an output property bag, in order.
OUTPUT_PROPERTIES = [
    "GISID",
    "Address",
    "Condition_YearBuilt",
    "PropertyClass",
    "Zoning",
    "age",
    "age_band",
    "join_status",
    "join_ambiguous",
]

OUTPUT_SCHEMA = (
    "GISID string, Address string, Condition_YearBuilt int, PropertyClass string, Zoning string, "
    "age int, age_band string, join_status string, join_ambiguous boolean"
)


def feature_json(geometry: Column, properties: list[Column]) -> Column:
    """One feature as JSON text; null members are written out."""
    bag = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit('{"type":"Feature","geometry":'),
        F.coalesce(geometry, F.lit("null")),
        F.lit(',"properties":'),
        bag,
        F.lit("}"),
    )


def output_features(df: DataFrame, ord: str = "building_ord", columns: list[str] = OUTPUT_PROPERTIES) -> DataFrame:
    """Output rows as ``(ord, feature)`` with rounded coordinates."""
    text = feature_json(F.col("geometry"), [F.col(c) for c in columns])
    return round_geometry(df).select(F.col(ord).alias("ord"), text.alias("feature"))


def write_features(df: DataFrame, path: str, layout: str = "parquet", ord: str = "building_ord") -> None:
    """Write output rows, replacing what is there.

    ``parquet``     a table, best for further jobs;
    ``lines``       newline-delimited features in input order;
    ``collection``  part files which, concatenated by name, are one FeatureCollection
                    document with one feature per line.
    """
    if layout == "parquet":
        round_geometry(df).write.mode("overwrite").parquet(path)
        return
    if layout == "lines":
        # Sorted as columns: a sort looks at its rows twice, and the texts are then made once.
        output_features(df.orderBy(ord), ord).select("feature").write.mode("overwrite").text(path)
        return
    if layout != "collection":
        raise ValueError(f"Unknown layout {layout!r}: expected parquet, lines or collection")
    features = _collection_lines(output_features(df, ord))
    features.orderBy("section", "ord").select("feature").write.mode("overwrite").text(path)


def _collection_lines(features: DataFrame) -> DataFrame:
    first_ord = features.agg(F.min("ord")).scalar()
    comma = F.when(F.col("ord") == first_ord, "").otherwise(",")
    body = features.select(F.lit(1).alias("section"), "ord", F.concat(comma, "feature").alias("feature"))
    ord_type = features.schema["ord"].dataType.simpleString()
    frame = features.sparkSession.createDataFrame(
        [(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "section int, feature string"
    ).selectExpr("section", f"cast(null as {ord_type}) as ord", "feature")
    return body.unionByName(frame)


def read_output(spark: SparkSession, path: str, layout: str = "parquet") -> DataFrame:
    """Rows that :func:`write_features` wrote, with typed columns."""
    if layout == "parquet":
        return spark.read.parquet(path)
    bag = F.from_json("properties_raw", OUTPUT_SCHEMA).alias("bag")
    features = read_features(spark, path, "lines").select(F.col("ord").alias("building_ord"), "geometry", bag)
    return features.select("building_ord", "geometry", "bag.*")


# --- preconditions ------------------------------------------------------------------------


def require_path(spark: SparkSession, path: str) -> None:
    """Raise ``ValueError`` when there is nothing at ``path``, or only empty files. Reads no rows.

    An empty file is no collection, not even an empty one; read by lines it would pass for no features.
    """
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"Nothing to read at {path}") from error
        raise
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(files.getContentSummary(found.getPath()).getLength() for found in files.globStatus(pattern)):
        raise ValueError(f"Only empty files at {path}")


def key_list(properties_raw: Column) -> Column:
    """Keys of a property bag in document order."""
    return F.json_object_keys(properties_raw)
