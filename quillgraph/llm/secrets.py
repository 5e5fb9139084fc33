"""Secret scans: strong patterns, and weak parts of multipart credentials that only count together.

Every part found in a text is an interval of code points with a role: access identifier, secret or endpoint. Strong
parts (key assignments, access keys, long hex) are always reported. Weak parts (account names, base64-like runs,
service addresses) are reported only if parts of complementary roles that don't overlap them begin within `reach` code
points of their start: an identifier needs a secret, a secret an identifier, an endpoint both. The scope is the text.

The interval join is a band join within each row: its parts are sorted by start, and as parts of one kind don't
overlap and have a least length, only a fixed number of neighbours can begin within reach. So it is linear in the
number of parts, needs no shuffle, and no group of rows meets in one task. Native expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A pattern of parts. `least`: code points that group `sized` must have; `shortest`: of any match."""

    name: str
    role: str
    pattern: str
    strong: bool
    shortest: int
    sized: int = 0
    least: int = 0


# The patterns of the contract, in the order that breaks ties of position. The runs of the last two are
# as long as they can be, so that asking for the length within the pattern finds the same ones.
STRONG = (
    Kind("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 12, 2, 6),
    Kind("access", "identifier", r"AKIA[A-Z0-9]{16,}", True, 20),
    Kind("hex", "secret", r"[0-9a-f]{24,}", True, 24),
)
#: Parts that alone are too common to report.
WEAK = (
    Kind("account", "identifier", r"""(?i:client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+""", False, 6),
    Kind("blob", "secret", r"[A-Za-z0-9+/]{32,}", False, 32),
    Kind("endpoint", "endpoint", r"""(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|amqp)://[A-Za-z0-9._~:@%-]+""", False, 7),
)
KINDS = STRONG + WEAK

_PART = "struct<start:int,order:int,end:int>"
_BLOCK = 256  # matches whose positions are summed up at once: lists grow by blocks, so long ones stay linear


def _matches(text: Column, kind: Kind) -> Column:
    """For each match in order: code points between it and the one before, its length, and that of its sized group."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.length)
    sized = F.transform(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.sized)), F.length) if kind.sized else whole
    gaps = F.slice(F.transform(F.split(text, kind.pattern, -1), F.length), 1, F.size(whole))
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), sized.alias("sized"))
    return F.when(text.rlike(kind.pattern), rows).otherwise(F.array().cast("array<struct<gap:int,len:int,sized:int>>"))


def _parts(rows: Column, kind: Kind, order: int) -> Column:
    """The matches that are long enough, with their positions: running sums of gaps and lengths."""
    none = F.array().cast(f"array<{_PART}>")

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + r["gap"]
        part = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + r["len"]).alias("end"))
        return F.struct((start + r["len"]).alias("at"), F.when(r["sized"] >= kind.least, F.concat(a["out"], F.array(part))).otherwise(a["out"]).alias("out"))

    def block(a: Column, rows: Column) -> Column:
        done = F.aggregate(rows, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(done["out"])).alias("out"))

    split = F.transform(F.sequence(F.lit(0), ((F.size(rows) - 1) / _BLOCK).cast("int")), lambda b: F.slice(rows, b * _BLOCK + 1, F.lit(_BLOCK)))
    found = F.aggregate(split, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_PART}>>").alias("out")), block)["out"]
    return F.when(F.size(rows) > 0, F.flatten(found)).otherwise(none)


def _near(parts: Column, i: Column, part: Column, role: str, reach: int) -> Column:
    """Whether a part of the role begins within reach of the i-th (from 0) of the sorted parts, beside it."""
    orders = [n for n, k in enumerate(KINDS) if k.role == role]
    span = sum(reach // k.shortest + 1 for k in KINDS) + len(KINDS)
    first = F.greatest(i - span, F.lit(0))
    hood = F.slice(parts, first + 1, F.lit(2 * span + 1))
    apart = lambda o: (o["start"] >= part["end"]) | (part["start"] >= o["end"])
    return F.exists(hood, lambda o: o["order"].isin(orders) & (F.abs(o["start"] - part["start"]) <= reach) & apart(o))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, and parts: array of kind, start, end (code points, end
    exclusive) and strong, by start, then in the order of kinds.

    Null and empty texts have no parts. Repeated rows are scanned each; other columns are ignored and may have any names.
    """
    names = list(keep or [])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)], text.alias("_text"))
    found = rows.select("*", *[_matches(F.col("_text"), k).alias(f"_m{i}") for i, k in enumerate(KINDS)])
    found = found.select("*", *[_parts(F.col(f"_m{i}"), k, i).alias(f"_p{i}") for i, k in enumerate(KINDS)])
    strong = F.concat(*[f"_p{i}" for i in range(len(STRONG))])
    weak = F.concat(*[f"_p{i}" for i in range(len(STRONG), len(KINDS))])
    needs = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}

    def linked(part: Column, i: Column) -> Column:
        out = F.lit(False)
        for role, others in needs.items():
            ok = part["order"].isin([n for n, k in enumerate(KINDS) if k.role == role])
            for other in others:
                ok = ok & _near(F.col("_all"), i, part, other, reach)
            out = out | ok
        return out

    found = found.select("*", F.array_sort(F.concat(strong, weak)).alias("_all"), (F.size(weak) > 0).alias("_weak"))
    reported = F.when(F.col("_weak"), F.filter("_all", lambda p, i: (p["order"] < len(STRONG)) | linked(p, i))).otherwise(F.col("_all"))
    kinds = F.array(*[F.lit(k.name) for k in KINDS])
    parts = F.transform(
        reported, lambda p: F.struct(F.element_at(kinds, p["order"] + 1).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), (p["order"] < len(STRONG)).alias("strong"))
    )
    # As the rows of a generator, parts are a column that a filter on them doesn't replace by all that leads to them.
    return found.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], F.explode(F.array(parts)).alias("parts"))
