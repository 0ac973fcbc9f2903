"""Named queries over the standard tables; each reads whole tables and whole texts."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, views
from ..operators import (
    audit, blocks, conversation, decide, encoded, evaluate, findings, metrics, redact, scan, spans, windows,
)
from ..operators.rules import PROFILES
from ..sources import readers, writers
from ..streaming import jobs as stream
from . import jobs, plants

AS_OF = dt.datetime(2024, 1, 31)  # the day after the last event
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ABSENT = ["us_ssn", "voter_id", "passport", "gst", "aws_key", "jwt", "anthropic_key", "bearer_token"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir):
    """Documents, spread for CPU-bound scans: small files would otherwise fill only a few tasks."""
    return spread(spark, table(spark, sf_dir, "documents"))


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Raise parallelism only when the input has fewer splits than the cluster has cores."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def requests(spark, sf_dir):
    """The events table read as a request log."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    types = (
        F.when(kind == "purchase", F.array(F.lit("CREDIT_CARD"), F.lit("EMAIL_ADDRESS")))
        .when(kind == "click", F.array(F.lit("PHONE_NUMBER")))
        .otherwise(F.array().cast("array<string>"))
    )
    return e.select(
        F.col("event_id").alias("id"),
        audit.as_utc("ts").alias("timestamp"),
        "user_id",
        kind.alias("status"),
        F.when(kind == "purchase", "block").when(kind == "click", "redact").otherwise("pass").alias("action"),
        F.when(kind == "purchase", "high").when(kind == "click", "low").otherwise("none").alias("severity"),
        types.alias("types"),
        F.col("value").alias("latency_ms"),
        (kind == "error").alias("is_error"),
    )


def joined(col: str):
    return F.array_join(F.array_sort(col), "|")


# --- scan and decision ---------------------------------------------------------------


@query
def severity_counts(spark, sf_dir):
    s = scan.scan_types(texts(spark, sf_dir))
    return decide.with_decision(s, "standard").groupBy("severity").agg(F.count("*").alias("n"))


@query
def findings_by_type(spark, sf_dir):
    return metrics.detections_by_type(scan.scan_types(texts(spark, sf_dir)))


@query
def findings_by_source_lang(spark, sf_dir):
    return metrics.detections_by_type(scan.scan_types(texts(spark, sf_dir)), by=["source", "lang"])


@query
def scan_decisions(spark, sf_dir):
    s = decide.with_decision(scan.scan_types(texts(spark, sf_dir)), "standard")
    return s.select(
        "doc_id", F.array_join("detections", "|").alias("types"), "severity", "block", "redact",
        decide.action(F.col("block"), F.col("redact")).alias("action"),
    )


@query
def scan_decisions_hardened(spark, sf_dir):
    s = decide.with_decision(scan.scan_types(texts(spark, sf_dir), profile="hardened"), "hardened")
    return s.select("doc_id", F.array_join("detections", "|").alias("types"), "severity", "block", "redact")


def _planted(spark, sf_dir):
    return plants.with_plants(texts(spark, sf_dir)).select("doc_id", "plant", "alone", "text")


@query
def planted_types(spark, sf_dir):
    """What the standard rules find of a sample of every rule, in a text and alone."""
    s = scan.scan_types(_planted(spark, sf_dir))
    return s.select("plant", "alone", F.explode("detections").alias("type")).groupBy("plant", "alone", "type").agg(F.count("*").alias("n"))


@query
def planted_decisions(spark, sf_dir):
    """D1, D2 on the planted documents."""
    s = decide.with_decision(scan.scan_types(_planted(spark, sf_dir)), "standard")
    return s.groupBy("plant", "alone", "severity", "block").agg(F.count("*").alias("n"))


@query
def planted_encoded_findings(spark, sf_dir):
    """P3 as rows, nested base64 included."""
    return findings.encoded_findings(_planted(spark, sf_dir), ["doc_id"])


@query
def html_pii_pages(spark, sf_dir):
    pages = spread(spark, table(spark, sf_dir, "pages"))
    s = decide.with_decision(scan.scan_types(pages, "html"), "standard")
    return s.select("page_id", F.array_join("detections", "|").alias("types"), "severity")


@query
def severity_by_policy_join(spark, sf_dir):
    found = scan.scan_types(texts(spark, sf_dir), encoded=False).select("doc_id", F.explode("detections").alias("type"))
    policy = decide.severity_policy(spark)
    rows = findings.severity_of_rows(findings.with_severity(found, policy), ["doc_id"])
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.sum("n_types").alias("types"))


@query
def absent_type_counts(spark, sf_dir):
    d = scan.with_views(texts(spark, sf_dir), "text")
    refs = scan.view_refs(d)
    rules = {r.rule_id: r for r in PROFILES["standard"].rules}
    return d.agg(*[F.count_if(F.expr(rules[r].fires(refs))).cast("long").alias(r) for r in ABSENT])


def _values(spark, sf_dir, *rule_ids):
    """One row per rule, view and value, with its first place in the raw text."""
    found = findings.findings(texts(spark, sf_dir), ["doc_id"], rule_ids=list(rule_ids))
    return found.select("doc_id", "type", "value", *_long("start", "end"), "rule_id", "view")


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@query
def email_findings(spark, sf_dir):
    return _values(spark, sf_dir, "email")


@query
def phone_findings(spark, sf_dir):
    return _values(spark, sf_dir, "phone_country_code", "phone_in", "phone_us")


@query
def ipv4_findings(spark, sf_dir):
    return _values(spark, sf_dir, "ipv4")


@query
def secret_findings(spark, sf_dir):
    return _values(spark, sf_dir, "generic_secret")


@query
def title_name_findings(spark, sf_dir):
    return _values(spark, sf_dir, "name_title_case")


@query
def card_luhn_findings(spark, sf_dir):
    return _values(spark, sf_dir, "credit_card")


@query
def merged_places(spark, sf_dir):
    """Overlapping values of a type, of whatever rule and view, as one place in the raw text."""
    rules = ["email", "phone_country_code", "phone_in", "phone_us", "ipv4", "generic_secret", "name_title_case", "credit_card"]
    found = findings.merged_findings(texts(spark, sf_dir), ["doc_id"], rule_ids=rules)
    return found.select("doc_id", "type", *_long("start", "end"), joined("rules").alias("rules"), joined("views").alias("views"), "text")


@query
def prefilter_parity(spark, sf_dir):
    """Rows on which the gated and ungated scans differ (none)."""
    d = scan.with_views(texts(spark, sf_dir), "text")
    refs = scan.view_refs(d)
    fast = F.expr(scan.type_list(PROFILES["standard"], refs, True))
    slow = F.expr(scan.type_list(PROFILES["standard"], refs, False))
    return d.agg(F.count("*").alias("texts"), F.count_if(fast != slow).alias("different"))


@query
def encoded_findings(spark, sf_dir):
    return findings.encoded_findings(texts(spark, sf_dir), ["doc_id"])


@query
def encoded_runs(spark, sf_dir):
    """Base64 runs per text and how many are padded."""
    d = texts(spark, sf_dir).select("doc_id", scan.base_text(F.col("text"), PROFILES["standard"]).alias("base"))
    return d.select("doc_id", *encoded.run_counts("base"))


@query
def encoded_readable(spark, sf_dir):
    """Base64 runs per text that decode to enough text to be scanned."""
    d = texts(spark, sf_dir).select("doc_id", scan.base_text(F.col("text"), PROFILES["standard"]).alias("base"))
    return d.select("doc_id", encoded.readable("base", PROFILES["standard"].min_decoded).alias("readable"))


@query
def encoded_round_trip(spark, sf_dir):
    """Every text is encoded once and rescanned: what is found plainly, found again with one prefix, lost, or invented."""
    d = texts(spark, sf_dir)
    sealed = F.base64(F.encode("text", "UTF-8"))
    for end in "\r\n":  # of the encoder's lines
        sealed = F.replace(sealed, F.lit(end), F.lit(""))
    plain = scan.scan_types(d.select("doc_id", "text", sealed.alias("sealed")), encoded=False)
    both = scan.scan_types(plain.select("doc_id", "sealed", F.col("detections").alias("plain")), "sealed")
    inner = F.transform(F.filter("detections", lambda t: t.rlike("^BASE64_(?!BASE64_)")), lambda t: F.substring(t, 8, 100))
    rows = both.select("plain", inner.alias("hidden")).select("plain", "hidden", F.explode(F.array_union("plain", "hidden")).alias("type"))
    shown, again = F.array_contains("plain", F.col("type")), F.array_contains("hidden", F.col("type"))
    return rows.groupBy("type").agg(F.count_if(shown & again).alias("n"), F.count_if(~again).alias("lost"), F.count_if(~shown).alias("invented"))


# --- views ------------------------------------------------------------------------------


@query
def normalization_views(spark, sf_dir):
    """Fingerprints of the views of every text."""
    base = views.base_view(F.col("text"))
    d = texts(spark, sf_dir).select("doc_id", base.alias("b"))
    shown = {
        "base": F.col("b"),
        "leet": views.leet_fold(F.col("b")),
        "leet_all": views.leet_fold_all(F.col("b")),
        "ocr_compact": views.ocr_compact(F.col("b")),
        "dot_dash": views.dot_to_dash(F.col("b")),
        "no_space": views.without_space(F.col("b")),
        "word_chars": views.word_chars(F.col("b")),
        "alnum": views.alnum_only(F.col("b")),
        "digits": views.digits_only(F.col("b")),
        "licence": views.licence_fold(F.col("b")),
    }
    return d.select("doc_id", *[F.md5(c.cast("binary")).alias(n) for n, c in shown.items()])


@query
def ocr_view(spark, sf_dir):
    """Fingerprints of the texts whose digit-like runs were repaired."""
    d = texts(spark, sf_dir).select("doc_id", views.base_view(F.col("text")).alias("b"))
    d = d.withColumn("ocr", views.ocr_fold(F.col("b")))
    return d.select("doc_id", F.md5(F.col("ocr").cast("binary")).alias("ocr"), (F.col("ocr") != F.col("b")).alias("changed"))


@query
def nfkc_exact(spark, sf_dir):
    d = texts(spark, sf_dir)
    return d.select("doc_id", F.md5(views.exact_nfkc(F.col("text")).cast("binary")).alias("nfkc"))


@query
def span_steps(spark, sf_dir):
    """Which normalization steps changed each text."""
    d = spans.with_steps(texts(spark, sf_dir), "text")
    step = d.select("doc_id", F.posexplode("steps").alias("n", "s"))
    return step.groupBy("n", F.col("s.name").alias("name")).agg(
        F.count_if(F.coalesce(F.col("s.note") != "no-op", F.lit(False))).alias("changed"),
        F.sum(F.length("s.output")).alias("chars"),
    ).withColumn("n", F.col("n").cast("long"))


# --- span profile -------------------------------------------------------------------------


@query
def span_findings(spark, sf_dir):
    """Hits of all four views, and of the fallback rules on reduced texts, with their places in the raw text."""
    found = spans.span_findings(texts(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "type", "value", *_long("start", "end"), "view", "reduced")


@query
def span_severities(spark, sf_dir):
    """Findings of the span profile by severity level."""
    policy = decide.severity_policy(spark, "spans")
    return findings.with_severity(span_findings(spark, sf_dir), policy).groupBy("level", "blocks").agg(F.count("*").alias("n"))


@query
def span_redactions(spark, sf_dir):
    """X3 by place: the hits of all views replaced in the raw text."""
    done = spans.redact_places(texts(spark, sf_dir), ["doc_id"])
    return done.select("doc_id", "places", F.md5(F.col("redacted").cast("binary")).alias("redacted_md5"))


@query
def span_decisions(spark, sf_dir):
    s = spans.scan_spans(texts(spark, sf_dir))
    return s.select("doc_id", joined("triggered").alias("types"), "action", F.length("redacted_prompt").alias("chars"))


@query
def span_actions(spark, sf_dir):
    s = spans.scan_spans(texts(spark, sf_dir))
    return s.groupBy("action").agg(F.count("*").alias("n"), F.sum(F.size("triggered")).cast("long").alias("types"))


# --- redaction --------------------------------------------------------------------------


@query
def redact_documents(spark, sf_dir):
    """X1/X4 with the reference chain."""
    s = scan.scan(texts(spark, sf_dir), coverage="reference")
    return s.select("doc_id", "redact", F.md5(F.col("redacted_text").cast("binary")).alias("redacted_md5"))


@query
def redact_documents_all(spark, sf_dir):
    """X1 with every covered type."""
    s = scan.scan(texts(spark, sf_dir))
    token = (F.length("redacted_text") - F.length(F.replace("redacted_text", F.lit(redact.TOKEN), F.lit("")))) / len(redact.TOKEN)
    return s.filter("redact").select("doc_id", "severity", token.cast("long").alias("tokens"))


@query
def redact_hardened(spark, sf_dir):
    s = scan.scan(texts(spark, sf_dir), profile="hardened", coverage="reference")
    return s.select("doc_id", "redact", F.md5(F.col("redacted_text").cast("binary")).alias("redacted_md5"))


# --- scalar functions -----------------------------------------------------------------------


@query
def sanitize_text(spark, sf_dir):
    d = table(spark, sf_dir, "pages")
    safe = checks.html_escape(F.col("html"))
    return d.select("page_id", F.length(safe).cast("long").alias("chars"), F.md5(safe.cast("binary")).alias("safe_md5"))


@query
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checks.preview(F.col("text")).alias("preview"))


@query
def mock_embedding(spark, sf_dir):
    vec = checks.mock_embedding(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(vec).cast("long").alias("width"),
        F.array_join(F.transform(vec, lambda x: x.cast("int").cast("string")), ",").alias("vector"),
    )


@query
def origin_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.concat(F.col("user_id").cast("string"), F.substring("props", 1, 16))
    return e.select("event_id", checks.origin_hash(key).alias("origin"))


# --- fingerprints -----------------------------------------------------------------------------


@query
def fingerprint_dupes(spark, sf_dir):
    return audit.repeats(table(spark, sf_dir, "documents"), "text", "doc_id")


def _logged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    return d.select(checks.fingerprint(F.col("text")).alias("redacted_fingerprint"))


@query
def seen_semi(spark, sf_dir):
    """Non-English texts whose fingerprint is already logged for English ones, and all English ones."""
    seen, _ = audit.split_seen(table(spark, sf_dir, "documents"), _logged(spark, sf_dir), "text")
    return seen.select("doc_id", "lang")


@query
def new_anti(spark, sf_dir):
    _, new = audit.split_seen(table(spark, sf_dir, "documents"), _logged(spark, sf_dir), "text")
    return new.select("doc_id", "lang")


# --- audit table ----------------------------------------------------------------------------------


def _audit(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select(
        "id", "timestamp", F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), "severity", "action",
        F.col("types").alias("detection_types"), F.to_date("timestamp").alias("dt"),
    )


def _stamped(df, *names):
    return df.select(F.unix_micros("timestamp").alias("ts_us"), *names)


@query
def audit_newest_page(spark, sf_dir):
    page = audit.query(_audit(spark, sf_dir), severity="high", limit=25, offset=50)
    return _stamped(page, "id", "user_id", "action")


@query
def audit_newest_100(spark, sf_dir):
    return _stamped(audit.query(_audit(spark, sf_dir), limit=100), "id", "user_id", "severity")


@query
def audit_tenant_newest_100(spark, sf_dir):
    """The newest 100 rows of one tenant."""
    return _stamped(audit.query(_audit(spark, sf_dir), tenant_id="t1", limit=100), "id", "tenant_id", "severity")


@query
def audit_newest_500(spark, sf_dir):
    """The client's log keeps the newest 500 rows."""
    return _stamped(audit.query(_audit(spark, sf_dir), limit=500), "id", "user_id", "severity")


@query
def audit_user_filter(spark, sf_dir):
    return _stamped(audit.query(_audit(spark, sf_dir), user_id="7", limit=20), "id", "severity")


@query
def audit_latest_per_user(spark, sf_dir):
    return _stamped(audit.latest_per_key(_audit(spark, sf_dir), 5), "id", "user_id")


@query
def retention_keep(spark, sf_dir):
    kept = audit.purge(_audit(spark, sf_dir), AS_OF, days=10)
    return kept.groupBy("dt").agg(F.count("*").alias("n")).select(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "n")


@query
def retention_purge(spark, sf_dir):
    """The audit table purged in place: old dates dropped, the cutoff's date rewritten, later files untouched."""
    path = f"{_run_folder(spark, 'audit')}/log"
    writers.append_audit(_audit(spark, sf_dir), path)
    writers.purge_dates(spark, path, AS_OF - dt.timedelta(hours=7), days=10)
    kept = spark.read.parquet(path)
    return kept.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"))


@query
def seen_in_index(spark, sf_dir):
    """Texts looked up in a bucketed table of all fingerprints that occur in conversations or more than once."""
    d = table(spark, sf_dir, "documents")
    twice = audit.repeats(d, "text", "doc_id").select(F.col("fingerprint").alias("redacted_fingerprint"))
    said = table(spark, sf_dir, "conversations").select(checks.fingerprint(F.col("text")).alias("redacted_fingerprint"))
    run = _run_folder(spark, "index")
    name = f"umbrascan_{uuid.uuid4().hex}"
    writers.fingerprint_index(twice.union(said), name, run, buckets=spark.sparkContext.defaultParallelism)
    seen, new = audit.split_seen_indexed(d, spark.table(name), "text")
    return seen.select("doc_id", F.lit(True).alias("seen")).union(new.select("doc_id", F.lit(False)))


@query
def audit_rows(spark, sf_dir):
    """Audit rows of the documents."""
    return _audit_columns(jobs.detect_job(texts(spark, sf_dir), F.lit(AS_OF)))


@query
def failure_policy(spark, sf_dir):
    """Every tenth scan counts as failed; such texts pass unmarked or are rejected."""
    s = decide.with_decision(scan.scan_types(texts(spark, sf_dir)), "standard")
    s = s.withColumn("error", F.when(F.col("doc_id") % 10 == 0, F.lit("timeout")))
    modes = [decide.failure_policy(s, mode=m).withColumn("mode", F.lit(m)) for m in ("fail_open", "fail_closed")]
    both = modes[0].unionByName(modes[1])
    return both.groupBy("mode", "status", "severity", "block").agg(F.count("*").alias("n"))


@query
def stored_audit(spark, sf_dir):
    """Documents written and read as JSON lines, scanned, appended to the audit table and read back."""
    run = _run_folder(spark, "stored")
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("section"), "text")
    lines.write.json(f"{run}/lines")
    corpus = readers.read_corpus(spark, f"{run}/lines")
    writers.append_audit(jobs.detect_job(spread(spark, corpus), F.lit(AS_OF), key_col="id"), f"{run}/log")
    return _audit_columns(readers.read_audit(spark, f"{run}/log"))


@query
def stream_audit(spark, sf_dir):
    """The document stream scanned into audit rows, read back."""
    run = _run_folder(spark, "stream-audit")
    table(spark, sf_dir, "documents").write.parquet(f"{run}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{run}/in").schema).parquet(f"{run}/in")
    query = stream.audit_stream(source, f"{run}/log", f"{run}/checkpoint", timestamp=F.lit(AS_OF), available_now=True)
    query.awaitTermination()
    return _audit_columns(readers.read_audit(spark, f"{run}/log"))


@query
def report_tables(spark, sf_dir):
    """The benchmark report, written as CSV and read back: its metric rows, and how many case rows it has."""
    run = _run_folder(spark, "report")
    facts = _case_labels(spark, sf_dir)
    judged = decide.with_decision(scan.scan_types(texts(spark, sf_dir).join(facts, "doc_id")), "standard")
    judged = blocks.written(judged.select("doc_id", "text", "label", "detections", "block"), "judged")
    writers.write_report(judged, evaluate.precision_recall(judged), f"{run}/report")
    cases = readers.read_csv(spark, f"{run}/report/cases", "text string, label string, detections string, block boolean")
    rows = readers.read_csv(spark, f"{run}/report/metrics", "label string, samples long, tp long, fp long, fn long, precision double, recall double")
    listed = cases.groupBy("label").agg(F.count("*").alias("cases"), F.sum(F.length("text")).alias("chars"))
    return rows.join(listed, "label")


def _audit_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "user_id", "redacted_fingerprint", F.array_join("detection_types", "|").alias("types"), "action",
        "severity", F.col("trace_metadata")["request_type"].alias("request_type"),
    )


@query
def worker_rows(spark, sf_dir):
    """A2: the worker path logs every text."""
    rows = jobs.worker_job(texts(spark, sf_dir), F.lit(AS_OF))
    return rows.groupBy("action", "severity").agg(F.count("*").alias("n"))


@query
def leak_audit(spark, sf_dir):
    """A14 over the texts as they are stored without redaction."""
    stored = table(spark, sf_dir, "documents").select(F.col("text").alias("redacted_prompt"))
    return audit.leak_summary(stored)


@query
def encryption_round_trip(spark, sf_dir):
    """Odd documents sealed with an old key that is rotated, even ones with a key that is not; some damaged, some of a
    key that nobody has.  What opens is compared with the fingerprint of the clear text."""
    keys = {k: F.substring(F.sha2(F.lit(k), 256), 1, 32) for k in ("k1", "k2", "k3", "lost")}
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("redacted_prompt"))
    d = d.withColumn("redacted_fingerprint", checks.fingerprint(F.col("redacted_prompt")))
    old, kept = audit.encrypt(d.filter("doc_id % 2 = 1"), keys["k1"], "k1"), audit.encrypt(d.filter("doc_id % 2 = 0 AND doc_id % 14 <> 0"), keys["k3"], "k3")
    lost = audit.encrypt(d.filter("doc_id % 14 = 0"), keys["lost"], "lost")
    sealed = old.unionByName(kept).unionByName(lost)
    bad = F.col("doc_id") % 11 == 0
    cut = F.expr("left(redacted_prompt_ciphertext, 24)")
    other = F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("redacted_fingerprint"))
    sealed = sealed.withColumns({"redacted_prompt_ciphertext": F.when(bad, cut).otherwise(F.col("redacted_prompt_ciphertext")), "redacted_fingerprint": other})
    rotated = audit.rotate_key(sealed, {"k1": keys["k1"]}, keys["k2"], "k2")
    return audit.verify_encryption(rotated, {k: keys[k] for k in ("k1", "k2", "k3")})


@query
def log_path(spark, sf_dir):
    """E-2: prompt and answer of a conversation turn pair through sanitize, moderation and escalation."""
    return _log_path(table(spark, sf_dir, "conversations"))


@query
def planted_log_path(spark, sf_dir):
    """Answers that hold something raise their row."""
    return _log_path(plants.with_turn_plants(table(spark, sf_dir, "conversations")))


def _log_path(c: DataFrame) -> DataFrame:
    ask = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("redacted_prompt"))
    answer = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("llm_response_redacted")
    )
    pairs = ask.join(answer, ["conv_id", "turn"], "left").withColumns(
        {
            "user_id": F.col("conv_id").cast("string"), "tenant_id": F.lit(None).cast("string"),
            "detection_types": F.array().cast("array<string>"), "action": F.lit("allow"),
            "severity": F.lit("low"), "timestamp": F.lit(AS_OF),
        }
    )
    rows = jobs.log_job(pairs)
    return rows.select(
        "conv_id", "turn", "action", "severity", "redacted_fingerprint",
        F.col("trace_metadata")["output_moderation"].alias("moderation"),
    )


@query
def csv_export(spark, sf_dir):
    """The export columns of the request log."""
    r = requests(spark, sf_dir)
    log = r.select(
        "timestamp", F.col("user_id").alias("api_key"), F.lit("00000000").alias("origin_hash"),
        F.concat(F.lit('say "'), F.col("status"), F.lit('"')).alias("raw_preview"),
        F.col("status").alias("redacted_prompt"), "action", F.col("types").alias("triggered_patterns"), "latency_ms",
    )
    return writers.csv_view(log)


@query
def request_log(spark, sf_dir):
    """Client-side audit rows of the span profile."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    c = c.withColumn("prompt", F.col("text"))
    rows = jobs.request_log(c, text_col="prompt", api_key=F.col("conv_id"), timestamp=F.lit(AS_OF))
    return rows.select("api_key", "origin_hash", "raw_preview", "action")


# --- validation and schema ----------------------------------------------------------------


@query
def validation_split(spark, sf_dir):
    """Valid and rejected texts, with a limit that some texts exceed."""
    d = readers.with_validity(table(spark, sf_dir, "documents"), max_chars=20_000)
    return d.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars")
    )


@query
def schema_evolution(spark, sf_dir):
    """An older layout without tenant and response columns, unioned with the newer one."""
    new = _audit(spark, sf_dir).withColumn("tenant_id", F.concat(F.lit("t"), F.col("id") % 3))
    old = _audit(spark, sf_dir).drop("action", "tenant_id")
    both = readers.union_versions(new, old)
    return both.groupBy("tenant_id", "action").agg(F.count("*").alias("n"))


@query
def tenant_resolution(spark, sf_dir):
    """Header, then claims, else empty; rows without tenant are quarantined."""
    e = table(spark, sf_dir, "events")
    header = F.when(F.col("event_type") == "view", F.concat(F.lit("h"), F.col("user_id") % 4))
    claims = F.when(F.col("event_type") != "error", F.regexp_replace("props", '"k"', '"org"'))
    d = e.withColumn("tenant_id", decide.resolve_tenant(header, claims))
    return d.groupBy("tenant_id").agg(F.count("*").alias("n"))


# --- metrics -----------------------------------------------------------------------------------


@query
def kpi_block(spark, sf_dir):
    return metrics.kpi_block(requests(spark, sf_dir))


@query
def kpi_by_user(spark, sf_dir):
    return metrics.kpi_block(requests(spark, sf_dir), ["user_id"])


@query
def hourly_kpis(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("hour", F.unix_seconds(F.date_trunc("hour", "timestamp")))
    return metrics.kpi_block(r, ["hour"])


@query
def upper_median_latency(spark, sf_dir):
    return metrics.upper_median(requests(spark, sf_dir), "latency_ms")


@query
def upper_median_by_user(spark, sf_dir):
    return metrics.upper_median(requests(spark, sf_dir), "latency_ms", ["user_id"])


@query
def distinct_filter_choices(spark, sf_dir):
    r = requests(spark, sf_dir)
    keys = metrics.distinct_keys(r, "user_id").select(F.lit("key").alias("kind"), F.col("user_id").cast("string").alias("choice"))
    types = metrics.distinct_types(r).select(F.lit("type").alias("kind"), F.col("type").alias("choice"))
    return keys.unionByName(types)


@query
def filtered_slice(spark, sf_dir):
    r = requests(spark, sf_dir)
    last = metrics.filtered_slice(r, AS_OF, 168, action="block", pattern="CREDIT_CARD")
    return _stamped(last, "id", "user_id")


@query
def slo_snapshot(spark, sf_dir):
    return metrics.slo_snapshot(requests(spark, sf_dir))


@query
def slo_breaches(spark, sf_dir):
    out = windows.slo_breaches(requests(spark, sf_dir), window=200)
    return out.select("id", F.col("samples").cast("long").alias("samples"), "error_rate", "p95_over", "breach")


@query
def slo_breach_count(spark, sf_dir):
    return metrics.breach_counter(windows.slo_breaches(requests(spark, sf_dir), window=200))


@query
def slo_breaches_by_status(spark, sf_dir):
    out = windows.slo_breaches(requests(spark, sf_dir), by=["status"])
    return out.select("id", F.col("samples").cast("long").alias("samples"), "error_rate", "breach")


@query
def request_counters(spark, sf_dir):
    return metrics.counters(requests(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(requests(spark, sf_dir))


@query
def status_tally(spark, sf_dir):
    return metrics.status_tally(requests(spark, sf_dir))


@query
def type_severity_rollup(spark, sf_dir):
    r = requests(spark, sf_dir).select(F.explode("types").alias("type"), "severity")
    return metrics.type_severity_rollup(r)


# --- windows -------------------------------------------------------------------------------------


@query
def quota_decisions(spark, sf_dir):
    r = requests(spark, sf_dir)
    out = windows.quota_decisions(r, key="status", quota=2, window_s=3600)
    return out.select("id", "window_start", F.col("rank").cast("long").alias("rank"), "allowed")


@query
def quota_counts(spark, sf_dir):
    return windows.quota_counts(requests(spark, sf_dir), key="status", quota=2, window_s=3600)


@query
def quota_by_policy(spark, sf_dir):
    """Per-user quotas with a default; the policy table holds one row per even user."""
    r = requests(spark, sf_dir)
    policy = r.select("user_id").distinct().filter("user_id % 2 = 0").withColumn("quota", (F.col("user_id") % 3 + 1).cast("int"))
    d = windows.with_policy(r, policy, "user_id", default_quota=1)
    out = windows.quota_decisions(d, key="user_id", quota=F.col("quota"), window_s=86_400)
    return out.groupBy("allowed").agg(F.count("*").alias("n"))


@query
def alert_rule(spark, sf_dir):
    r = requests(spark, sf_dir)
    out = windows.alert_rule(r, key="status", violation=F.col("latency_ms") > 20, window_s=1800)
    return out.select("id", F.col("violations").cast("long").alias("violations"))


@query
def alert_triggers(spark, sf_dir):
    return windows.alert_triggers(requests(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("alerts"))


@query
def alert_suppression(spark, sf_dir):
    """High alerts to one mailbox per event type, two per hour."""
    r = requests(spark, sf_dir).select(F.col("status").alias("recipient"), F.col("timestamp").alias("ts"), "id")
    out = windows.suppress_alerts(r, limit=2)
    return out.select("recipient", "id", "sent")


# --- conversations -----------------------------------------------------------------------------


@query
def conversation_prompts(spark, sf_dir):
    return conversation.conversation_text(table(spark, sf_dir, "conversations"))


@query
def last_user_turn(spark, sf_dir):
    return windows.last_user_turn(table(spark, sf_dir, "conversations"))


def _moderated(turns: DataFrame) -> DataFrame:
    m = conversation.moderate_turns(turns)
    return m.select("conv_id", "turn", "strict_blocked", "reason", "high_blocked")


@query
def moderated_turns(spark, sf_dir):
    return _moderated(table(spark, sf_dir, "conversations"))


@query
def planted_moderation(spark, sf_dir):
    """D5, D6 on turns that hold something."""
    return _moderated(plants.with_turn_plants(table(spark, sf_dir, "conversations")))


@query
def planted_conversations(spark, sf_dir):
    """Flagged conversations get their last user turn rewritten, blocked ones stay as they are."""
    out = conversation.redact_conversations(plants.with_turn_plants(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", "role", "text", "action")


@query
def redacted_conversations(spark, sf_dir):
    out = conversation.redact_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "text", "action")


@query
def intercepted_flows(spark, sf_dir):
    """Documents as chat payloads of watched and other hosts."""
    d = texts(spark, sf_dir)
    watched = F.col("lang").isin("en", "fr")
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("text").alias("content")),
            ).alias("messages")
        )
    )
    flows = d.select(
        "doc_id",
        F.when(watched, "api.openai.com").otherwise("example.org").alias("host"),
        F.lit("/v1/chat/completions").alias("path"),
        body.alias("body"),
    )
    out = jobs.intercept_job(flows)
    return out.groupBy("action").agg(
        F.count("*").alias("n"), F.count("forwarded_body").alias("forwarded"), F.sum(F.size("messages")).alias("messages")
    )


@query
def response_redaction(spark, sf_dir):
    """Document texts as model responses."""
    d = texts(spark, sf_dir).select("doc_id", F.col("text").alias("response"))
    out = conversation.redact_responses(d)
    return out.groupBy("severity").agg(F.count("*").alias("n"), F.count("shown_response").alias("shown"))


# --- evaluation ---------------------------------------------------------------------------------


def _predicted(spark, sf_dir, labelled=False):
    """Scanned documents; only those with a label, if no other is looked at afterwards."""
    d = texts(spark, sf_dir)
    if labelled:
        d = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    s = decide.with_decision(scan.scan_types(d), "standard")
    return s.select("doc_id", "source", "detections", "redact", "severity")


@query
def label_confusion(spark, sf_dir):
    return evaluate.confusion(
        _predicted(spark, sf_dir, True), table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1, F.col("redact")
    )


@query
def label_precision_recall(spark, sf_dir):
    return evaluate.quality(
        evaluate.confusion(
            _predicted(spark, sf_dir, True), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 0, F.col("redact")
        )
    )


@query
def case_precision_recall(spark, sf_dir):
    """E1 over labelled documents: good ones count as negatives, the rest as positives or adversarial."""
    judged = _predicted(spark, sf_dir, True).select("doc_id", "detections").join(_case_labels(spark, sf_dir), "doc_id")
    return evaluate.precision_recall(judged)


def _case_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "adversarial").when(F.col("quality") == 1, "negative").otherwise("positive").alias("label"),
    )


@query
def corpus_accuracy(spark, sf_dir):
    """The document source plays the corpus section."""
    s = _predicted(spark, sf_dir).withColumnRenamed("source", "section")
    names = [f"src{i}" for i in range(40)]
    expectations = evaluate.section_expectations(spark, names[::2]).withColumn("expect_redact", F.lit(False))
    return evaluate.corpus_accuracy(s, expectations)


def _both_profiles(spark, sf_dir):
    """Types by the hardened and the standard rules, in one pass over the texts."""
    hard = scan.scan_types(texts(spark, sf_dir), profile="hardened").withColumnRenamed("detections", "hardened")
    return scan.scan_types(hard).withColumnRenamed("detections", "standard").drop("text")


@query
def run_comparison(spark, sf_dir):
    """The hardened run against the standard one, per source."""
    found = _both_profiles(spark, sf_dir).select(F.col("source").alias("section"), *[(F.size(p) > 0).alias(p) for p in ("hardened", "standard")])
    counted = blocks.written(found.groupBy("section", "hardened", "standard").agg(F.count("*").alias("texts")), "runs")
    none = evaluate.section_expectations(spark, ["none"])
    tables = []
    for profile in ("hardened", "standard"):
        rows = counted.withColumn("redact", F.col(profile))
        tables.append(evaluate.corpus_accuracy(rows, none, weight="texts").select("section", "total", "actual", "correct"))
    return evaluate.compare_runs(*tables)


@query
def bypass_rate(spark, sf_dir):
    """Documents with an address sign should be found as e-mail, all others should be clean."""
    s = _predicted(spark, sf_dir).select("doc_id", "detections")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.contains("text", F.lit("@")).alias("should_detect"),
        F.when(F.contains("text", F.lit("@")), F.array(F.lit("EMAIL_ADDRESS"))).alias("expected_types"),
    )
    return evaluate.bypass_rate(evaluate.bypasses(s.join(d, "doc_id")))


@query
def run_regressions(spark, sf_dir):
    """O2: types of the standard rules that the hardened rules no longer report, per document."""
    lost = evaluate.lost_types(F.col("standard"), F.col("hardened"))
    return metrics.detections_by_type(_plain_types(_both_profiles(spark, sf_dir)).withColumn("detections", lost))


@query
def findings_over_runs(spark, sf_dir):
    """O1: what either profile reports, each document and type once."""
    either = F.array_union("standard", "hardened")
    return metrics.detections_by_type(_plain_types(_both_profiles(spark, sf_dir)).withColumn("detections", either))


def _plain_types(found: DataFrame) -> DataFrame:
    """Without the types of base64 contents, which are no rows of the findings table."""
    return found.withColumns({p: F.filter(p, lambda t: ~t.startswith("BASE64_")) for p in ("hardened", "standard")})


@query
def late_requests(spark, sf_dir):
    """Requests more than half a day behind the newest of their day, by status."""
    r = requests(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    newest = r.groupBy("day").agg(F.max("timestamp").alias("newest"))
    return stream.late_rows(r.join(newest, "day"), F.col("newest"), minutes=720).groupBy("status").agg(F.count("*").alias("late"))


# --- streaming: file sources drained with availableNow ---------------------------------------


def _run_folder(spark, name):
    local = spark.sparkContext.master.startswith("local[")
    root = stream.checkpoint_root(spark, tempfile.gettempdir() if local else None)
    return f"{root}/umbrascan-{name}-{uuid.uuid4().hex}"


def _arrivals(spark, sf_dir, run, slices, delay=None):
    """The events in files of their order of arrival, as a stream that takes one file per micro-batch.

    ``delay`` is how long after its time an event arrives; slices are of equal length in time.
    """
    e = table(spark, sf_dir, "events").withColumn("__at", audit.as_utc("ts") + (F.expr("interval 0 seconds") if delay is None else delay))
    first, last = e.agg(F.unix_micros(F.min("__at")), F.unix_micros(F.max("__at"))).first()
    width = ((last or 0) - (first or 0)) // slices + 1
    for i in range(slices):
        low = (first or 0) + i * width
        part = e.filter((F.unix_micros("__at") >= low) & (F.unix_micros("__at") < low + width)).drop("__at")
        part.coalesce(1).write.mode("append").parquet(f"{run}/in")
    return spark.readStream.schema(spark.read.parquet(f"{run}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")


def _drain(spark, build, sf_dir, name, table_name, mode="append", stateful=False, latest=(), slices=0):
    """Streams a table, a file or a folder of files, and reads what the stream has written.

    With ``slices``, the events arrive in as many micro-batches.  In update mode the newest row of each ``latest`` key is
    the result.
    """
    run = _run_folder(spark, name)
    source = table(spark, sf_dir, table_name)
    one = source.select("_metadata.file_path").limit(1).collect()
    if slices:
        streamed = _arrivals(spark, sf_dir, run, slices)
    elif one and one[0][0].endswith(f"/{table_name}.parquet"):  # the table is a single file
        streamed = spark.readStream.schema(source.schema).option("pathGlobFilter", f"{table_name}.parquet").parquet(sf_dir)
    else:
        streamed = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/{table_name}.parquet")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if stateful:
        spark.conf.set(key, stream.ROCKSDB)
    try:
        stream.run_available(build(streamed), f"{run}/checkpoint", stream.append_batches(f"{run}/out"), mode)
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(f"{run}/out")
    if latest:
        names = [c for c in out.columns if c not in latest]
        out = out.groupBy(*latest).agg(F.max_by(F.struct(*names), "batch").alias("row")).select(*latest, "row.*")
    return out.drop("batch")


def _stream_requests(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("id"), audit.as_utc("ts").alias("timestamp"), "event_type",
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"),
    )


@query
def stream_scan(spark, sf_dir):
    """The document stream scanned in append mode."""
    cores = spark.sparkContext.defaultParallelism

    def build(d):
        scanned = stream.scan_stream(d.repartition(cores * 2))
        return scanned.select("doc_id", F.array_join("detections", "|").alias("types"), "severity", "action")

    return _drain(spark, build, sf_dir, "scan", "documents")


@query
def stream_quota_counts(spark, sf_dir):
    """T3 in update mode: windows behind the watermark leave the state; the newest row of each window counts."""
    build = lambda e: stream.quota_counts(_stream_requests(e), key="event_type", quota=2, window_s=3600)
    out = _drain(spark, build, sf_dir, "quota", "events", mode="update", latest=["event_type", "window_start"], slices=4)
    return out.withColumnRenamed("event_type", "status")


@query
def stream_exact_alerts(spark, sf_dir):
    """T4, exact."""
    build = lambda e: stream.exact_alerts(
        _stream_requests(e), key="event_type", violation=F.col("latency_ms") > 20, window_s=1800
    )
    return _drain(spark, build, sf_dir, "alerts", "events", stateful=True, slices=4).filter("NOT late").select("id")


@query
def stream_slo_monitor(spark, sf_dir):
    """T5: status per event type after the drain."""
    build = lambda e: stream.slo_monitor(_stream_requests(e), service=F.col("event_type"))
    return _drain(spark, build, sf_dir, "slo", "events", mode="update", stateful=True, latest=["service"], slices=4)


@query
def stream_alert_suppression(spark, sf_dir):
    """Two alerts per hour and mailbox."""
    build = lambda e: stream.suppress_alerts(
        _stream_requests(e).withColumnRenamed("timestamp", "ts"), recipient="event_type", limit=2
    )
    return _drain(spark, build, sf_dir, "suppress", "events", stateful=True, slices=4).select("recipient", "id", "sent")


@query
def stream_late_counts(spark, sf_dir):
    """Events of every seventh id arrive two days late; rows behind the watermark go to a side output and are counted."""
    run = _run_folder(spark, "late")
    delay = F.when(F.col("event_id") % 7 == 0, F.expr("interval 2 days")).otherwise(F.expr("interval 0 days"))
    arriving = _stream_requests(_arrivals(spark, sf_dir, run, 6, delay))
    stream.run_available(arriving, f"{run}/checkpoint", stream.split_late(f"{run}/out"))
    counts = spark.read.parquet(f"{run}/out/counts")
    rows = spark.read.parquet(f"{run}/out/rows").groupBy("batch").agg(F.count_if("late").alias("written_late"))
    return counts.join(rows, "batch").select(F.col("batch").cast("long").alias("batch"), "n", "late", "written_late")
