"""Secrets in texts, with weak parts of credentials reported where they complete each other; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: (kind, pattern, group that is measured, its least length) of spans that count by themselves.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: (kind, pattern, role) of parts that count only with the others.
WEAK = (
    ("ident", r"""(?i:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+""", "id"),
    ("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}", "secret"),
    ("endpoint", r"https?://[A-Za-z0-9.:@_-]+", "endpoint"),
)
ROLES = {"access": "id", "assign": "secret", "hex": "secret"} | {kind: role for kind, _, role in WEAK}
#: Parts that a weak span needs in its scope, besides itself.
NEEDS = {"ident": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}
SCOPE = 400  # characters between the starts of parts of one credential
ORDER = {kind: i for i, kind in enumerate(("assign", "access", "hex", "ident", "key", "endpoint"))}

_ANY = r"(?i:passw|secret|token|api_?key|user|login|client_?id|account_?id|access_?key)|AKIA|[0-9a-f]{24}|https?://"


def spans(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``(keep, kind, start, end)`` of every candidate, base and weak; code points, end exclusive.

    A pattern's matches and the gaps between them alternate, so the starts
    are running sums of lengths; the sums run over exploded rows, a linear
    pass however many matches a text has.
    """
    likely = docs.where(F.rlike(text_col, F.lit(_ANY)))
    parts = None
    for kind, pattern, group, least in (*BASE, *((k, p, 0, 1) for k, p, _ in WEAK)):
        text = F.col(text_col)
        whole, measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        lengths = F.arrays_zip(
            F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
            F.transform(whole, F.length).alias("n"),
            F.transform(measured, F.length).alias("m"),
        )
        some = likely.where(F.rlike(text, F.lit(pattern))).select(*keep, F.posexplode(lengths).alias("i", "x"))
        some = some.select(*keep, F.lit(kind).alias("kind"), "i", "x.gap", "x.n", "x.m", F.lit(least).alias("least"))
        parts = some if parts is None else parts.unionByName(some)
    before = Window.partitionBy(*keep, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(before)
    placed = parts.distinct().withColumn("end", end).where("n is not null and m >= least")  # distinct: rows may repeat
    return placed.select(*keep, "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def linked(found: DataFrame, *keep: str, scope: int = SCOPE) -> DataFrame:
    """Base spans of ``found``, and the weak ones whose complements start within ``scope`` characters.

    An interval semi-join: a weak span asks for each role it needs in the
    cell of its start; a part answers in its own cell and the two beside it.
    No pairs are made.
    """
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.col("kind")]
    needs = F.create_map(*(x for kind, roles in NEEDS.items() for x in (F.lit(kind), F.array(*map(F.lit, roles)))))[F.col("kind")]
    cell = F.floor(F.col("start") / scope)
    weak = found.where(F.col("kind").isin(*NEEDS))
    asked = weak.select(*keep, "kind", "start", "end", cell.alias("cell"), F.explode(needs).alias("role"))
    parts = found.select(
        *(F.col(k).alias(f"p_{k}") for k in keep),
        F.col("start").alias("p_start"),
        role.alias("p_role"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("p_cell"),
    )
    same = F.lit(True)
    for k in keep:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    met = asked.join(
        parts,
        same & (F.col("cell") == F.col("p_cell")) & (F.col("role") == F.col("p_role")) & (F.abs(F.col("start") - F.col("p_start")) <= scope),
        "left_semi",
    )
    count = F.size(needs)
    whole = met.groupBy(*keep, "kind", "start", "end").agg(F.count("*").alias("n")).where(F.col("n") == count)
    return found.where(~F.col("kind").isin(*NEEDS)).unionByName(whole.drop("n"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: ``doc_id, row_key, spans``, an array of (start, order, kind, end).

    Assigned secrets, access key ids and long hexadecimal runs are reported
    wherever they stand.  Identifiers, mixed-case random strings and endpoints
    are weak: they are reported only when the parts that complete them, an
    identifier and a secret, start within ``scope`` characters.  A null or
    empty text has no spans; rows that repeat id and text have the same; null
    ids are allowed; extra columns are ignored; an empty table gives an empty
    result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    found = spans(base, "text", "doc_id", "row_key")
    order = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))[F.col("kind")]
    rows = (
        linked(found.distinct(), "doc_id", "row_key", scope=scope)
        .groupBy("doc_id", "row_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("spans"))
        .select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "spans")
    )
    joined = base.select("doc_id", "row_key").join(rows, (F.col("row_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", "row_key", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,order:int,kind:string,end:bigint>>)")).alias("spans"))


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all, per row of :func:`scan_secrets`."""
    base = "filter(spans, s -> s.order < 3)"
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )
