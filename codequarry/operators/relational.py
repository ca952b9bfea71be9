"""The users - chats - sessions - findings model: reads, reports and changes.

Tables come from the caller, so no join is told to broadcast one: Spark does so
where it knows that the side is below spark.sql.autoBroadcastJoinThreshold.
"""

from pyspark.sql import functions as F

# Finding types and their severity (1 Low, 2 Medium, 3 High, 4 Critical)
VULN_TYPES = (
    ("CSRF", 3), ("Insecure Cryptography", 3), ("Insecure Deserialization", 4), ("OS Command Injection", 4),
    ("Path Traversal", 2), ("SQL Injection", 4), ("XML Injection", 3), ("XSS", 3), ("Safe", 1),
)
SEVERITIES = {1: "Low", 2: "Medium", 3: "High", 4: "Critical"}


def vuln_types(spark):
    return spark.createDataFrame([(i + 1, n, s) for i, (n, s) in enumerate(VULN_TYPES)], "Id int, VulnName string, Severity int")


def severity_name(c):
    return F.try_element_at(F.create_map(*(F.lit(x) for p in SEVERITIES.items() for x in p)), c)


def owned(chats, chat_id, user_id):
    return chats.filter((F.col("Id") == chat_id) & (F.col("UserId") == user_id))


def session_tree(sessions, reports, results, types):
    """Each session with its report (or null) and the list of its findings (or an empty one), oldest first."""
    named = results.join(types.select(F.col("Id").alias("VulnTypeId"), "VulnName", "Severity"), "VulnTypeId")
    fields = [c for c in results.columns if c not in ("ScanId", "VulnTypeId")]
    item = F.struct("Id", "VulnName", severity_name(F.col("Severity")).alias("SeverityName"), *(c for c in fields if c != "Id"))
    nested = named.groupBy(F.col("ScanId").alias("Id")).agg(F.sort_array(F.collect_list(item)).alias("Findings"))
    out = sessions.join(reports.withColumnRenamed("ScanId", "Id"), "Id", "left").join(nested, "Id", "left")
    return out.withColumn("Status", F.when(F.col("Status"), "Vulnerable").otherwise("Safe"))


def ingest(findings, types):
    """Findings with their type's id; those of unknown names are left out (rejected() counts them)."""
    return findings.join(types.select(F.col("Id").alias("VulnTypeId"), F.col("VulnName").alias("label")), "label").drop("label")


def rejected(findings, types):
    return findings.join(types.select(F.col("VulnName").alias("label")), "label", "left_anti")


def first_or_null(df, predicate, order):
    """One row always: the first that the predicate holds for, or nulls."""
    first = F.min_by(F.struct(*df.columns), F.col(order)).alias("x")
    return df.filter(predicate).agg(first).select("x.*")


def newest(df, order, n=1):
    """The n last rows by `order`, a list of columns that decides."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def named(df, names, key, name, fallback="Untitled_Chat"):
    """df with the name that another table has for its key, or the fallback."""
    return df.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(name, F.coalesce("_name", F.lit(fallback))).drop("_name")


def first_match(df, by, predicate, value, order):
    """(by, value): the value of the first row of each group that the predicate holds for."""
    return df.filter(predicate).groupBy(*by).agg(F.min_by(value, order).alias(value))


def affected(df, predicate):
    """How many rows a change of those that the predicate holds for touches."""
    return df.agg(F.count_if(predicate).alias("affected"))


def compensated(df, failed, key):
    """df without what a failed ingest (key) has written already."""
    return df.join(failed.select(key).distinct(), key, "left_anti").select(df.columns)


def findings(sessions):
    """One row for each finding of sessions with a list Findings."""
    rest = [c for c in sessions.columns if c != "Findings"]
    return sessions.select(*rest, F.explode("Findings").alias("_f")).select(*rest, *(F.col(f"_f.{f.name}").alias(f.name) for f in sessions.schema["Findings"].dataType.elementType if f.name not in rest))


def updated(df, predicate, **values):
    """df with columns set where the predicate holds."""
    return df.withColumns({c: F.when(predicate, F.lit(v) if not hasattr(v, "_jc") else v).otherwise(F.col(c)) for c, v in values.items()})


def coalesced_update(df, delta, key):
    """df with the non-null values of delta's rows."""
    columns = [c for c in delta.columns if c != key]
    new = delta.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return out.drop(*(f"_{c}" for c in columns)).select(df.columns)


def cascade_delete(gone, *tables):
    """What is left of tables [(df, key, parent key column)], each the child of the one before, when rows `gone` (id) go."""
    out = []
    for df, key, parent in tables:
        lost = df.join(gone.select(F.col("id").alias(parent)), parent, "left_semi")
        out.append(df.join(gone.select(F.col("id").alias(parent)), parent, "left_anti").select(df.columns))
        gone = lost.select(F.col(key).alias("id"))
    return out


def insert_unique(df, new, key):
    """df and the rows of new whose key df hasn't."""
    return df.unionByName(new.join(df.select(key), key, "left_anti").select(df.columns))


def timeline(sessions):
    """Two messages for each session, the user's and the bot's, oldest session first."""
    both = F.array(F.struct(F.lit(0).alias("idx"), F.lit("user").alias("role"), F.col("FileName").alias("text")), F.struct(F.lit(1).alias("idx"), F.lit("bot").alias("role"), F.col("Status").alias("text")))
    return sessions.select("Id", "CreatedAt", F.explode(both).alias("m")).select("CreatedAt", "Id", "m.idx", "m.role", "m.text")


def report_text(head, findings):
    """A report's lines: a head, then one line for each of an array of findings (label, confidence, start_line, end_line, vuln_lines)."""
    line = lambda x: F.format_string("%s (%d%%) lines %d-%d [%s]", x["label"], F.round(100 * x["confidence"]).cast("int"), x["start_line"], x["end_line"], F.array_join(x["vuln_lines"].cast("array<string>"), ", "))
    return F.concat_ws("\n", head, F.array_join(F.transform(findings, line), "\n"))
