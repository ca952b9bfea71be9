"""Readers and writers."""

import uuid
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("vuln_code", "state", "safe_code", "safe_code_label")])
LINEAGE = ("_subtype", "_lang", "_framework", "_context", "_table", "_output_ctx", "_sub_key")
CHECKPOINT = T.StructType([*PAIR.fields, *(T.StructField(n, T.StringType()) for n in LINEAGE)])

# Extensions of uploads
EXTENSIONS = ("js", "jsx", "ts", "tsx", "py", "java", "cs", "php", "html", "htm", "rb", "go", "rs", "c", "cpp", "h", "sql", "xml", "cshtml")

# Names of families that are written otherwise
FAMILY_ALIASES = {"Path_Traversal": "Path Traversal", "Cross Site Scripting (XSS)": "XSS", "safe": "Safe"}


@dataclass(frozen=True)
class Settings:
    """What a generator run is given."""

    target: int = 2700
    token_budget: int = 509
    chars_per_token: float = 3.5
    ngram: int = 4
    percent: int = 80
    checkpoint_every: int = 10

    @classmethod
    def from_environment(cls, values, prefix="GEN_"):
        """Settings from a mapping such as os.environ; unknown names are left out."""
        kinds = {n: type(f.default) for n, f in cls.__dataclass_fields__.items()}
        return cls(**{n: kinds[n](values[prefix + n.upper()]) for n in kinds if values.get(prefix + n.upper())})


def keys_of(values, name):
    """The keys of a list such as "a, b" or of name, name_2, name_3 ..."""
    listed = [x.strip() for x in values.get(name, "").split(",")]
    k = 2
    while values.get(f"{name}_{k}"):
        listed.append(values[f"{name}_{k}"].strip())
        k += 1
    return list(dict.fromkeys(x for x in listed if x))


def read_jsonl(spark, path, schema=PAIR):
    """Strict: a malformed line fails; blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_checkpoint(spark, path, schema=CHECKPOINT):
    """Tolerant: bad lines are dropped, a missing file is empty."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_uploads(spark, path):
    """(filename, content) of files with a known extension that aren't blank; broken UTF-8 is replaced."""
    return uploads(spark.read.format("binaryFile").load(path))


def uploads(files):
    """As read_uploads, of rows (path, content)."""
    from codequarry.functions.text import extension, strip

    out = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content"))
    out = out.filter(extension(F.col("filename")).isin(*EXTENSIONS)).withColumn("content", lossy_text(F.col("content")))
    return out.filter(strip(F.col("content")) != "")


def lossy_text(c):
    """Bytes as UTF-8, what isn't replaced by U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def file_contents(df, path_column, spark, folder):
    """df with the bytes of the file at a path, null if the path is blank or not there."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias(path_column), "content")
    return df.join(files, path_column, "left")


def ingested(files, schema=PAIR):
    """Rows of JSONL files (filename, content): (rows, errors), errors as (filename, line, text) for each line that isn't such an object.

    A bad line costs its file nothing else, and a bad file the others nothing.
    """
    lines = files.select("filename", F.posexplode(F.split("content", "\n")).alias("at", "text")).filter(F.trim("text") != "")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("x", F.from_json("text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    rows = parsed.filter("x._bad is null").select("filename", *(F.col(f"x.{f.name}").alias(f.name) for f in schema))
    return rows, parsed.filter("x._bad is not null").select("filename", (F.col("at") + 1).cast("long").alias("line"), "text")


def family(c):
    names = F.create_map(*(F.lit(x) for p in FAMILY_ALIASES.items() for x in p))
    return F.coalesce(F.try_element_at(names, c), c)


def training_rows(pairs):
    """(code, label, pair_id, family): both sides of each pair (pair_id, vuln_code, safe_code, state)."""
    sides = F.array(F.struct(F.col("vuln_code").alias("code"), F.lit("Vulnerable").alias("label")), F.struct(F.col("safe_code").alias("code"), F.lit("Safe").alias("label")))
    return pairs.select("pair_id", family(F.col("state")).alias("family"), F.explode(sides).alias("x")).select("x.code", "x.label", "pair_id", "family")


def export(df):
    """Without internal columns."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def write_jsonl(df, path):
    df.write.mode("overwrite").json(path)


def write_metrics(df, path):
    """One row as one JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_graph(path, **tables):
    """Writes the tables of an ingest and commits them as one: readers see all of them or none.

    Each ingest has its own folder under a name of its own; the commit is an
    empty file, made when all tables are written.
    """
    number, path = uuid.uuid4().hex, path.rstrip("/")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/ingest={number}")
    spark = next(iter(tables.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{number}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False).close()


def read_graph(spark, path, name):
    """A table of the committed ingests; an error where there is none."""
    path = path.rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return spark.read.parquet(*(f"{path}/{name}/ingest={f.getPath().getName()}" for f in files))
