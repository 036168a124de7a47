"""Secret scans with multipart credential linking; DataFrame functions only.

A text's matches come from two regular-expression passes: what stands between the
matches, and the matches; their lengths in code points add up to the positions.
The whole scan is one projection, so it needs no exchange, and a document's cost
follows its length.

Linking: identifiers (access keys, and client or account ids that are assigned),
secrets and endpoints are parts of a credential.  A scope is the stretch of
``SCOPE`` code points around a part.  A bare secret-like word is too weak to be
reported by itself; it is a ``linked`` span if an identifier lies in its scope, an
endpoint is an ``endpoint`` span if an identifier and a secret do, and an
identifier that is weak itself is an ``ident`` span if a secret does.  The
interval join runs over a document's own spans, each kind sorted, by halving: a text
of very many parts costs their number times its logarithm.

Edge cases: null texts count as empty; overlapping kinds are all kept; repeated
rows give repeated results; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Both kinds are whole runs, so asking for the least length at once finds the same matches as dropping shorter ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Searched first; a text without it has no match that counts.
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
HEX_HINT = r"[0-9a-f]{24}"
IDENT = r"""(?i:client_?id|account_?id|access_?key_?id|user_?name|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
#: Whole runs, with base64 padding; the name in ``NAME=value`` is none.  After a dot only the parts of dotted tokens, as a path follows a host's dot.
BARE = r"""(?:(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{32,}+|(?<=\.)[A-Za-z0-9_-]{32,}+(?![+/]))(?:={1,2}(?!=|["']?[A-Za-z0-9+/_-])|(?!=))"""
#: URLs, dotted names under any top-level domain, IP addresses and localhost; the scope join decides which of them count.
ENDPOINT = r"""(?i)(?<![\p{L}\p{N}._-])(?:[a-z][a-z0-9+.-]*+://[^\x00-\x20"'<>]{4,}+|[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++(?<=\.\p{L}[\p{L}\p{N}-]{1,62})(?![@_])|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}_-]|\.[0-9])|\[[0-9a-f]*+:[0-9a-f:.]++\]|localhost(?![\p{L}\p{N}._-]))"""
SCOPE = 300
#: Positions are added up in runs, so that appending stays cheap in texts with very many matches.
RUN = 256
SPAN = "struct<kind:string,rank:int,start:long,end:long,len:long>"
KINDS = {"assign": 0, "access": 1, "hex": 2, "linked": 3, "ident": 4, "endpoint": 5}


def cut(text: Column, pattern: str, kind: str, ok: Column, group: int = 0) -> dict[str, Column]:
    """Columns with what stands between the leftmost non-overlapping matches, the matches, and the lengths of their groups."""
    empty = F.array().cast("array<string>")
    of = lambda c: F.when(ok, c).otherwise(empty)
    out = {f"{kind}_gaps": of(F.split(text, pattern, -1)), f"{kind}_hits": of(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))}
    return out | ({f"{kind}_parts": of(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))} if group else {})


def spans(kind: str, rank: str, grouped: bool = False, least: int = 1) -> Column:
    """The matches of ``cut`` whose group is long enough, as an array of SPAN.

    Each column is named more than once here, so the optimizer keeps it a column
    and runs its regular expression once a text, not once a match.
    """
    gaps, hits = F.col(f"{kind}_gaps"), F.col(f"{kind}_hits")
    parts = F.col(f"{kind}_parts") if grouped else hits
    empty = F.array().cast(f"array<{SPAN}>")
    count = F.least(F.size(gaps) - 1, F.size(hits), F.size(parts))

    def one(acc, i):
        start = acc["at"] + F.char_length(F.get(gaps, i))
        end = start + F.char_length(F.get(hits, i))
        span = F.struct(F.lit(rank).alias("kind"), F.lit(KINDS[rank]).alias("rank"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.char_length(F.get(parts, i)).cast("long").alias("len")).cast(SPAN)
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(acc, first):
        upto = F.least(first + RUN, count) - 1
        return F.aggregate(F.sequence(first, upto), F.struct(acc["at"].alias("at"), empty.alias("out")), one, lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    found = F.aggregate(F.sequence(F.lit(0), count - 1, F.lit(RUN)), start, run, lambda acc: F.filter(F.flatten(acc["out"]), lambda s: s["len"] >= least))
    return F.when(count > 0, found).otherwise(empty)


def any_near(a: Column, others: list[Column], scope: int) -> Column:
    """Whether a span of ``others`` lies within ``scope`` of ``a``; 0 asks for an overlap.

    Each array holds one kind's spans, sorted and apart, so its last span that does
    not start after ``a`` and the one that follows decide; both are found by halving.
    """

    def one(spans):
        n = F.size(spans)

        def halve(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            left = (acc["lo"] < acc["hi"]) & (F.get(spans, mid)["start"] <= a["start"])
            return F.struct(F.when(left, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(left, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi"))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)
        upto = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda acc: acc["lo"])
        before = F.coalesce(a["start"] < F.get(spans, upto - 1)["end"] + scope, F.lit(False))
        return F.when(n > 0, before | F.coalesce(F.get(spans, upto)["start"] < a["end"] + scope, F.lit(False))).otherwise(False)

    found = one(others[0])
    for o in others[1:]:
        found = found | one(o)
    return found


def as_text(found: Column, least_rank: int = len(KINDS)) -> Column:
    kept = F.filter(found, lambda s: s["rank"] < least_rank)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: all spans by start and kind, base kinds and linked parts."""
    none = F.array().cast(f"array<{SPAN}>")
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    t = t.withColumns(cut(text, ASSIGN, "a", text.rlike(ASSIGN_HINT), 2) | cut(text, ACCESS, "k", text.contains("AKIA")) | cut(text, HEX, "x", text.rlike(HEX_HINT)) | cut(text, IDENT, "i", text.rlike(IDENT), 1))
    t = t.select("doc_id", "text", spans("a", "assign", True, 6).alias("assign"), spans("k", "access").alias("access"), spans("x", "hex").alias("hex"), spans("i", "ident", True, 3).alias("weak_id"))
    has_id = (F.size("access") > 0) | (F.size("weak_id") > 0)
    t = t.withColumns(cut(text, BARE, "b", has_id) | cut(text, ENDPOINT, "h", has_id))
    t = t.select("doc_id", "assign", "access", "hex", "weak_id", spans("b", "linked", least=32).alias("bare"), spans("h", "endpoint", least=6).alias("host"))
    of = lambda *names: [F.col(n) for n in names]
    ids, proofs = of("access", "weak_id"), of("assign", "hex", "linked")
    # a base span reported already, or the identifier itself, is no weak secret
    linked = F.filter("bare", lambda s: ~any_near(s, of("assign", "access", "hex", "weak_id"), 0) & any_near(s, ids, scope))
    t = t.withColumn("linked", F.when(has_id & (F.size("bare") > 0), linked).otherwise(none))
    t = t.withColumn("ident", F.when(F.size("weak_id") > 0, F.filter("weak_id", lambda i: any_near(i, proofs, scope))).otherwise(none))
    t = t.withColumn("endpoint", F.when(F.size("host") > 0, F.filter("host", lambda e: any_near(e, ids, scope) & any_near(e, proofs, scope))).otherwise(none))
    found = F.concat("assign", "access", "hex", "linked", "ident", "endpoint")
    key = lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["len"])
    ordered = F.transform(F.array_sort(F.transform(found, key)), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["len"].alias("len")))
    return t.select("doc_id", F.when(F.size(found) > 0, ordered).otherwise(none).alias("found"))


def op7_credential_linking(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole document: base kinds, digest, and all spans with the linked parts."""
    t = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == KINDS[k])).cast("long").alias(f"n_{k}")
    return t.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(F.col("found"), 3), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
