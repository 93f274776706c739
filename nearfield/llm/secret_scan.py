"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has a row for
each pair of blob and rule version that was scanned, with its findings. A run scans only the pairs
that the ledger lacks, each once however many paths hold the blob, and joins findings back to paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, broadcast_if_small, documents
from nearfield.llm.spans import blotted, contains_any, count_kind, joined, spans, tagged

#: Changes whenever a rule does; findings of another version are not reused.
RULES = "2026-1"
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
PEM = "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
#: A whole private key: through the next END line unless another line of dashes comes first, else with the headers and the base64 that follow.
_BREAK = r"(?:\s|\\[nr])"
PEM_WHOLE = (
    PEM + r"(?:[^-]*+(?:-(?!----)[^-]*+){0,500}+-----END [A-Z ]{0,32}PRIVATE KEY-----"
    rf"|(?:(?:\s++[A-Za-z][A-Za-z0-9-]{{2,30}}+:[^\r\n]*+){{0,4}}+(?:{_BREAK}++[A-Za-z0-9+/=]{{16,}}+(?={_BREAK}|$)){{1,1000}}+(?:{_BREAK}++[A-Za-z0-9+/=]++(?=[\r\n]|\\[nr]|$))?+)?+)"
)
BASE_KINDS = ("assign", "access", "hex")
LEDGER = "blob string, rules string, findings array<struct<order:int,start:int,end:int,kind:string>>"


def _findings(text: Column, whole: bool) -> Column:
    """Spans of all rules. The first three are the base; the others are well-known formats of keys. ``pem`` spans the BEGIN line, or the ``whole`` key."""
    words = contains_any(F.lower(text), "password", "passwd", "secret", "token", "apikey", "api_key")
    assign = tagged(spans(text, ASSIGN, words), "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    # A run that is too short cannot hold a longer match, so the least length may stand in the pattern.
    access = tagged(spans(text, "AKIA[A-Z0-9]{12,}+", contains_any(text, "AKIA")), "access", 1)
    hexes = tagged(spans(text, "[0-9a-f]{32,}+"), "hex", 2)
    pem = tagged(spans(text, PEM_WHOLE if whole else PEM, contains_any(text, "PRIVATE KEY-----")), "pem", 3)
    code = tagged(spans(text, "gh[pousr]_[A-Za-z0-9]{36,}+", contains_any(text, "ghp_", "gho_", "ghu_", "ghs_", "ghr_")), "hub_token", 4)
    chat = tagged(spans(text, "xox[abprs]-[A-Za-z0-9-]{10,}+", contains_any(text, "xox")), "chat_token", 5)
    web = tagged(spans(text, "eyJ[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+", contains_any(text, "eyJ")), "web_token", 6)
    return F.concat(assign, access, hexes, pem, code, chat, web)


class Ledger:
    """A stored ledger: a folder of Parquet files, to which every run adds the pairs that it scanned."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri

    def rows(self) -> DataFrame | None:
        """``blob, rules, findings`` of all pairs so far; None before the first run."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.uri)

    def scan(self, versions: DataFrame, rules: str = RULES, whole: bool = False) -> DataFrame:
        """Scan what the ledger lacks, store it, and return ``path, blob, findings`` of all ``versions`` from what is stored."""
        rules = f"{rules}-whole" if whole else rules
        new, places = _scan_unseen(versions, self.rows(), rules, whole)
        new.write.mode("append").parquet(self.uri)
        return _back(places, self.rows().filter(F.col("rules") == rules))


def _scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: str, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The new rows of the ledger, and ``path, blob`` of all versions, both as written tables."""
    scratch = Scratch(versions.sparkSession)
    addressed = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    places = scratch.table(addressed.select("path", "blob"), "places")
    repeated = places.groupBy("blob").agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1").select("blob", "first", F.lit(True).alias("repeated"))
    repeated = scratch.table(repeated, "repeated")
    rows = addressed.join(broadcast_if_small(repeated), "blob", "left").filter(F.col("repeated").isNull() | F.col("path").eqNullSafe(F.col("first")))
    if ledger is not None:
        known = ledger.filter(F.col("rules") == rules).select("blob")
        unseen = scratch.table(places.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        rows = rows.join(broadcast_if_small(unseen), "blob", "left_semi")
    found = rows.select("blob", F.lit(rules).alias("rules"), _findings(F.col("text"), whole).alias("findings"))
    new = scratch.table(found.dropDuplicates(["blob"]), "ledger")
    scratch.drop("repeated", "unseen")
    return new, places


def _back(places: DataFrame, ledger: DataFrame) -> DataFrame:
    """``path, blob, findings``: what the ledger has, joined back to all paths. Hits are written, so that Spark knows their size and splits a blob that very many paths hold."""
    hits = ledger.filter(F.size("findings") > 0).select("blob", "findings").join(places.select("blob").distinct(), "blob", "left_semi")
    hits = Scratch(places.sparkSession).table(hits, "hits")
    none = F.array().cast(hits.schema["findings"].dataType)
    return places.join(broadcast_if_small(hits), "blob", "left").select("path", "blob", F.coalesce("findings", none).alias("findings"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scan ``versions(path, text)``, of which a path may have many, against ``ledger``.

    Returns the new rows of the ledger, as a written table, and ``path, blob, findings`` for each row
    of ``versions``. A null text counts as empty. Null and repeated paths and rows are kept as they
    are. An empty table gives empty results; other columns are ignored. With ``whole`` spans of private
    keys cover the keys, and ``rules`` is another version. A text's cost is linear in its length and in
    its number of spans; very long texts are searched whole.

    Texts are read twice, for their addresses and for the scan, and stay where they are: of a blob
    that several rows hold, only rows of its least path are scanned, and which blobs are repeated or
    unseen is a table of addresses, broadcast within a checked size (beyond it, texts meet them by
    exchange). A blob's findings are kept once.
    """
    rules = f"{rules}-whole" if whole else rules
    new, places = _scan_unseen(versions, ledger, rules, whole)
    return new, _back(places, new if ledger is None else ledger.filter(F.col("rules") == rules).select("blob", "rules", "findings").unionByName(new))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs(doc_id, text, ...)`` with each stretch of ``text`` that findings cover replaced by ``mark``, private keys whole; other columns and null texts stay.

    Null and repeated ids and equal rows are rows like others; an empty table gives no rows; a column
    of any other name stays as it is. Very long texts and texts of many secrets cost time in proportion.
    """
    scratch = Scratch(docs.sparkSession)
    ledger, _ = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), whole=True)
    places = F.transform("findings", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = scratch.table(ledger.filter(F.size("findings") > 0).select("blob", places.alias("found")), "found")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("blob"))
    rows = rows.join(broadcast_if_small(found), "blob", "left")
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(blotted(F.col("row.text"), F.col("found"), mark))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of all spans of secrets in ``documents``, read back from the stored ledger.

    The ledger lies where the session's ``nearfield.secrets.ledger`` says, so that a later run scans
    new texts only; where that is unset, in a folder of this run, so that all texts are new.
    """
    uri = spark.conf.get("nearfield.secrets.ledger", None) or Scratch(spark).folder("ledger")
    found = Ledger(spark, uri).scan(documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text"))
    base = F.filter("findings", lambda s: s["order"] < len(BASE_KINDS))
    counts = [count_kind(F.col("findings"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(base, True), 256).alias("base_sha256"), joined(F.col("findings"), True).alias("spans"))
