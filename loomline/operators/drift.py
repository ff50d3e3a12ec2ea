"""Schemas that drift between files: matched by similarity flooding, then cast and united.

Every file gets a schema graph: the file, its fields, and for each field its contents per series, its
type, the parts of its name and its nested names. For two successive files of a writer the pairs of
nodes of equal kind form a propagation graph along equally labelled edges. Pairs of fields start with
the likeness of their names only; what their contents have in common enters at the pairs of content
nodes and reaches the fields by flowing through the graph until all similarities settle. Pairs of a
field gone and a field come are then chosen one to one by falling settled similarity: those that reach
ACCEPT are renamings, the rest are additions and removals.

Defined cases. Payloads that are null or no JSON object are unreadable and do not count; a record
delivered twice counts once in the table. A field exists in a file if a readable record holds it
non-null. Files of a null writer form one writer. Empty tables give empty results.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from loomline.runtime import cut, join_small

CHANGES = "file_id bigint, change string, field_name string, old_name string, old_type string, new_type string, similarity double"
PROFILE = "file_id bigint, profile string, fields array<string>"
CONTENT = "file_id bigint, field string, series bigint, content bigint"

#: Most rounds of the flow, and the change below which it has settled.
ROUNDS, SETTLED = 60, 1e-4
#: Weights of what a pair of fields hears from, by edge label.
WEIGHTS = {"contents": 8.0, "part": 1.0, "type": 0.5, "has": 0.5, "inner": 0.5}
#: Share of a pair's similarity that flows in, by kind of node; pairs of fields without common series lean on their names.
FLOW = {"field": 0.85, "unmet": 0.5, "contents": 0.2, "type": 0.2, "part": 0.2, "inner": 0.2, "file": 0.2}
#: Settled similarity from which two fields are one.
ACCEPT = 0.38
#: Agreement in a single content may be chance: it counts by this share.
ONE_CONTENT = 0.4
#: Records a task takes in before it hands on its partial profiles or contents.
HELD_RECORDS = 20_000
#: Pairs of files that a task compares, and most tasks for that.
PAIRS_A_TASK, MOST_TASKS = 200, 10_000
#: How a number in a string may begin.
NUMERIC = set("0123456789+-.")
ROLES = ("series_id", "sid", "seriesId")


#: JSON type of what a value is read as.
KINDS = {bool: "boolean", int: "integer", float: "fraction", str: "string", dict: "object", list: "array"}


def kind_of(v: object) -> str:
    """JSON type: boolean, integer, fraction, string, object, array."""
    return KINDS[type(v)]


def pairs_of(v: object) -> list[tuple[str, str]] | None:
    """Label pairs of tags written as object, array of pairs or ``k=v,k=v`` text; None if it is neither."""
    if isinstance(v, dict):
        return sorted((str(k), str(x)) for k, x in v.items() if x is not None)
    if isinstance(v, str) and "=" in v and re.fullmatch(r"[^=,]+=[^=,]*(?:,[^=,]+=[^=,]*)*", v):
        return sorted(tuple(p.split("=", 1)) for p in v.split(","))
    if isinstance(v, list) and v:
        out = []
        for x in v:
            if isinstance(x, str) and "=" in x:
                out.append(tuple(x.split("=", 1)))
            elif isinstance(x, (list, tuple)) and len(x) == 2:
                out.append((str(x[0]), str(x[1])))
            elif isinstance(x, dict) and len(x) == 2:
                low = {k.lower(): y for k, y in x.items()}
                name = next((low[k] for k in ("key", "name", "k", "label") if k in low), None)
                val = next((low[k] for k in ("value", "v", "val") if k in low), None)
                if name is None:
                    return None
                if val is not None:
                    out.append((str(name), str(val)))
            elif isinstance(x, dict) and len(x) == 1:
                out.extend((str(k), str(y)) for k, y in x.items())
            else:
                return None
        return sorted(out)
    return None


def content(v: object, p: list[tuple[str, str]] | None = None) -> str:
    """One spelling for a content, whatever its JSON type: numbers by value, signed checksums unsigned, tags (as pairs ``p``) sorted."""
    if p is not None:
        return "tags:" + ",".join(f"{k}={x}" for k, x in p)
    if isinstance(v, bool):
        return f"is:{str(v).lower()}"
    if isinstance(v, str):
        s = v.strip()
        if s[:1] not in NUMERIC:
            return f"is:{s.lower()}" if s.lower() in ("true", "false") else f"s:{s}"
        if re.fullmatch(r"0[xX][0-9a-fA-F]{1,8}", s):
            return f"n:{int(s, 16)}"
        try:
            v = int(s)
        except ValueError:
            try:
                v = float(s)
            except ValueError:
                return f"s:{s}"
    if isinstance(v, (int, float)):
        if v != v or v in (float("inf"), float("-inf")):
            return f"n:{v}"
        if float(v).is_integer():
            i = int(v)
            return f"n:{i + 2**32 if -(2**31) <= i < 0 else i}"
        return f"n:{v:.12g}"
    return "j:" + json.dumps(v, sort_keys=True)


def readable(payload: object) -> dict | None:
    if not isinstance(payload, str):
        return None
    try:
        o = json.loads(payload)
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def series_of(o: dict) -> str:
    """The series of a record by its field's usual names, or else the one number too large for a time or checksum."""
    for k in ROLES:
        if o.get(k) is not None:
            return str(o[k])
    for v in o.values():
        if isinstance(v, int) and not isinstance(v, bool) and v > 2**53 or isinstance(v, str) and v.isdigit() and len(v) > 15 and int(v) > 2**53:
            return str(v)
    return "?"


class Profile:
    """What a file holds, per field: types, forms, nested names. Profiles of parts of a file add up."""

    def __init__(self) -> None:
        self.fields: dict[str, dict] = {}

    def field(self, name: str) -> dict:
        return self.fields.setdefault(name, {"types": {}, "forms": {}, "inner": {}})

    def add(self, o: dict, forms: bool = True) -> None:
        """Count in a record. ``forms``: also what its values can be cast to, which only the one table needs."""
        for k, v in o.items():
            if v is None:
                continue
            f = self.fields.get(k) or self.field(k)
            kind = KINDS[type(v)]
            types = f["types"]
            types[kind] = types.get(kind, 0) + 1
            if forms:
                form = form_of(v)
                f["forms"][form] = f["forms"].get(form, 0) + 1
            if kind == "object" or kind == "array" or kind == "string" and "=" in v:
                inner = f["inner"]
                for name in v if kind == "object" else [name for name, _ in pairs_of(v) or ()]:
                    inner[name] = inner.get(name, 0) + 1

    def merge(self, other: dict[str, dict]) -> None:
        for k, g in other.items():
            f = self.field(k)
            for part in ("types", "forms", "inner"):
                for name, n in g[part].items():
                    f[part][name] = f[part].get(name, 0) + n


def main_type(types: dict[str, int]) -> str:
    """The most frequent type; whole numbers beside fractions are fractions."""
    t = Counter(types)
    if t["fraction"]:
        t["fraction"] += t.pop("integer", 0)
    return max(sorted(t), key=lambda k: t[k])


def name_parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if p]


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of character pairs of two names."""
    def grams(s: str) -> Counter:
        s = f"^{''.join(name_parts(s))}$"
        return Counter(s[i : i + 2] for i in range(len(s) - 1))

    x, y = grams(a), grams(b)
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


#: (old field, new field) -> common series, those whose contents meet, distinct contents that met.
Agreement = dict[tuple[str, str], tuple[int, int, int]]


def agreement(counts: Agreement, a: str, b: str) -> float | None:
    """Start similarity of the contents of two fields: the share of common series that agree, less for few; None without common series."""
    common, met, distinct = counts.get((a, b), (0, 0, 0))
    return met / (common + 1) * (1.0 if distinct > 1 else ONE_CONTENT) if common else None


def flood(old: dict[str, dict], new: dict[str, dict], counts: Agreement) -> dict[tuple[str, str], float]:
    """Settled similarity of every pair of fields of two files."""
    start: dict[tuple, float] = {("file", "", ""): 1.0}
    flow: dict[tuple, float] = {}
    links: dict[tuple, list[tuple]] = defaultdict(list)
    deaf: dict[tuple, float] = defaultdict(float)  # weight of what has no counterpart: it is heard as 0

    def edge(x: tuple, y: tuple, label: str, weight: float = 1.0) -> None:
        links[x].append((y, weight * WEIGHTS[label]))
        links[y].append((x, weight * WEIGHTS[label]))

    def leaves(pair: tuple, label: str, mine: list, other: list) -> None:
        both = set(mine) & set(other)
        every = len(set(mine) | set(other))
        for x in both:
            start[label, x, x] = 1.0
            edge(pair, (label, x, x), label, 1 / every)
        deaf[pair] += WEIGHTS[label] * (every - len(both)) / max(1, every)

    parts = {k: name_parts(k) for k in {*old, *new}}
    for a, f in old.items():
        for b, g in new.items():
            pair = ("field", a, b)
            start[pair] = name_similarity(a, b)
            edge(("file", "", ""), pair, "has")
            same = agreement(counts, a, b)
            flow[pair] = FLOW["unmet" if same is None else "field"]
            if same is not None:
                start["contents", a, b] = same
                edge(pair, ("contents", a, b), "contents")
            leaves(pair, "type", [main_type(f["types"])], [main_type(g["types"])])
            leaves(pair, "part", parts[a], parts[b])
            if f["inner"] or g["inner"]:
                leaves(pair, "inner", list(f["inner"]), list(g["inner"]))
    heard = {k: sum(w for _, w in v) + deaf[k] for k, v in links.items()}
    sim = {k: start[k] for k in links}
    for _ in range(ROUNDS):
        nxt = {}
        for k, v in links.items():
            c = flow.get(k) or FLOW[k[0]]
            nxt[k] = (1 - c) * start[k] + c * sum(w * sim[m] for m, w in v) / heard[k]
        moved = max((abs(nxt[k] - sim[k]) for k in nxt), default=0.0)
        sim = nxt
        if moved < SETTLED:
            break
    return {(k[1], k[2]): v for k, v in sim.items() if k[0] == "field"}


def correspond(old: dict[str, dict], new: dict[str, dict], counts: Agreement) -> dict[str, tuple[str, float]]:
    """New field -> (old field, similarity), one to one. Equal names stay; others must reach ACCEPT."""
    gone, come = set(old) - set(new), set(new) - set(old)
    sim = flood(old, new, counts) if gone and come else {}  # with nothing gone or nothing come, names alone decide
    found = {k: (k, sim.get((k, k), 1.0)) for k in new if k in old}
    for (a, b), s in sorted(sim.items(), key=lambda kv: (-kv[1], kv[0])):
        if s >= ACCEPT and a in gone and b in come:
            found[b] = (a, s)
            gone.discard(a)
            come.discard(b)
    return found


def compare(file_id: int, old: dict[str, dict], new: dict[str, dict], counts: Agreement) -> list[tuple]:
    out = []
    found = correspond(old, new, counts)
    for b in sorted(new):
        nt = main_type(new[b]["types"])
        if b not in found:
            out.append((file_id, "added", b, "", "", nt, 0.0))
            continue
        a, s = found[b]
        ot = main_type(old[a]["types"])
        if a != b:
            out.append((file_id, "renamed", b, a, ot, nt, s))
        if ot != nt:
            out.append((file_id, "retyped", b, "", ot, nt, s))
    for a in sorted(set(old) - {x for x, _ in found.values()}):
        out.append((file_id, "removed", a, "", main_type(old[a]["types"]), "", 0.0))
    return out


def profile_row(file_id: int, p: Profile) -> tuple:
    return file_id, json.dumps(p.fields), sorted(p.fields)


def partial_profiles(batches: Iterator[pd.DataFrame], forms: bool = True) -> Iterator[pd.DataFrame]:
    """Profiles of what a task sees of each file; nothing but profiles is ever shuffled."""
    held: dict[int, Profile] = {}
    n = 0

    def emit() -> pd.DataFrame:
        return pd.DataFrame([profile_row(f, p) for f, p in held.items()], columns=["file_id", "profile", "fields"])

    for b in batches:
        for f, payload in zip(b["file_id"], b["payload"]):
            p = held.get(f)
            if p is None:
                p = held[f] = Profile()  # a file whose records are all unreadable is a file without fields
            o = readable(payload)
            if o is not None:
                p.add(o, forms)
                n += 1
        if n >= HELD_RECORDS:
            yield emit()
            held, n = {}, 0
    if held:
        yield emit()


def whole_profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial profiles, sorted by file, added up."""
    at, p = None, Profile()
    for b in batches:
        out = []
        for f, part in zip(b["file_id"], b["profile"]):
            if f != at:
                if at is not None:
                    out.append(profile_row(at, p))
                at, p = f, Profile()
            p.merge(json.loads(part))
        yield pd.DataFrame(out, columns=["file_id", "profile", "fields"])
    if at is not None:
        yield pd.DataFrame([profile_row(at, p)], columns=["file_id", "profile", "fields"])


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct contents of each file, field and series, as far as one task sees them at once."""
    schema = pa.schema([("file_id", pa.int64()), ("field", pa.string()), ("series", pa.int64()), ("content", pa.int64())])
    held: dict[tuple, None] = {}
    n = 0

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)

    for b in batches:
        for f, payload in zip(b.column("file_id").to_pylist(), b.column("payload").to_pylist()):
            o = readable(payload)
            if o is None:
                continue
            sid = hash64(series_of(o))
            for k, v in o.items():
                if v is not None:
                    held[f, k, sid, hash64(content(v, pairs_of(v)))] = None
            n += 1
        if n >= HELD_RECORDS and held:
            yield emit()
            held, n = {}, 0
    if held:
        yield emit()


def agreements(blocks: DataFrame, moved: DataFrame) -> DataFrame:
    """Exact agreement of the fields of successive files ``moved`` (file_id, before): file_id and JSON list of [a, b, common, met, distinct].

    Of each two fields with different names: series that hold both, those in which a content of the one
    is a content of the other, and how many contents that is. Only these counts, one per two fields, come
    together by file.
    """
    wanted = moved.select("file_id").union(moved.select("before")).distinct()
    held = cut(join_small(blocks.select("file_id", "payload"), wanted, "file_id").mapInArrow(contents, CONTENT).distinct())
    old = join_small(held, moved.select(F.col("before").alias("file_id"), F.col("file_id").alias("pair")), "file_id").select("pair", "series", "content", F.col("field").alias("a"))
    new = join_small(held, moved.select("file_id"), "file_id").select(F.col("file_id").alias("pair"), "series", "content", F.col("field").alias("b"))
    both = ["pair", "a", "b"]
    met = old.join(new, ["pair", "series", "content"]).where("a <> b").groupBy(both).agg(F.count_distinct("series").alias("met"), F.count_distinct("content").alias("distinct"))
    # series with the same fields are counted before their fields are paired
    fields = [x.groupBy("pair", "series").agg(F.sort_array(F.collect_set(k)).alias(k)) for x, k in ((old, "a"), (new, "b"))]
    common = fields[0].join(fields[1], ["pair", "series"]).groupBy(both).agg(F.count(F.lit(1)).alias("n"))
    common = common.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where("a <> b").groupBy(both).agg(F.sum("n").alias("common"))
    counts = common.join(met, both, "left").na.fill(0, ["met", "distinct"])
    return counts.groupBy(F.col("pair").alias("file_id")).agg(F.to_json(F.collect_list(F.struct("a", "b", "common", "met", "distinct"))).alias("counts"))


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file_id", "change", "field_name", "old_name", "old_type", "new_type", "similarity"]
    for b in batches:
        rows = []
        for f, o, n, c in zip(b["file_id"], b["old"], b["new"], b["counts"]):
            counts = {(x["a"], x["b"]): (x["common"], x["met"], x["distinct"]) for x in json.loads(c)} if c else {}
            rows += compare(f, json.loads(o), json.loads(n), counts)
        yield pd.DataFrame(rows, columns=names)


def file_profiles(blocks: DataFrame, forms: bool = True) -> DataFrame:
    """One profile per file; every task makes partial ones of the files it sees, which are added up by file."""
    parts = blocks.where(F.col("file_id").isNotNull()).select("file_id", "payload").mapInPandas(partial(partial_profiles, forms=forms), PROFILE)
    return cut(parts.repartition("file_id").sortWithinPartitions("file_id").mapInPandas(whole_profiles, PROFILE))


def schema_changes(blocks: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Every change of fields from one file of a writer to the next.

    Files are put in order by thin rows in a window over their writer, and the profiles of two successive
    files are joined, so no task ever holds the records of a file or a whole writer. Contents of two files
    that have both a field gone and a field come are compared by joins over all their records.
    """
    rows = blocks.where(F.col("file_id").isNotNull())
    profiles = file_profiles(blocks, forms=False) if profiles is None else profiles
    order = Window.partitionBy("writer").orderBy("written_at", "file_id")
    files = rows.groupBy("file_id").agg(F.min("writer").alias("writer"), F.min("written_at").alias("written_at"))
    pairs = files.withColumn("before", F.lag("file_id").over(order)).where("before is not null").select("file_id", "before")
    new = profiles.select("file_id", F.col("profile").alias("new"), F.col("fields").alias("come"))
    old = profiles.select(F.col("file_id").alias("before"), F.col("profile").alias("old"), F.col("fields").alias("gone"))
    both = cut(pairs.join(new, "file_id").join(old, "before"))
    # contents matter only where a field went and another came
    moved = both.where((F.size(F.array_except("gone", "come")) > 0) & (F.size(F.array_except("come", "gone")) > 0)).select("file_id", "before")
    # few bytes and much work a pair of files, so the number of tasks follows the number of pairs
    tasks = min(MOST_TASKS, both.count() // PAIRS_A_TASK + 1)
    both = both.join(agreements(rows, moved), "file_id", "left")
    return both.select("file_id", "old", "new", "counts").repartition(tasks, "file_id").mapInPandas(compared, CHANGES)


# ---------------------------------------------------------------------------------------------- one table

TABLE = "file_id bigint, row_no int, timestamp bigint, value double, series_id bigint, labels_crc32 bigint, tags string, crc_ok boolean"
CORE_FIELDS = ("timestamp", "value", "series_id", "labels_crc32", "tags")
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
#: Types of the table's columns by the type that a field is cast to; pairs and nested values are JSON text.
COLUMN = {"boolean": BooleanType(), "integer": LongType(), "fraction": DoubleType(), "string": StringType(), "pairs": StringType(), "nested": StringType()}


def canonical_names(changes: DataFrame, limit: int = 100_000) -> dict[str, str]:
    """Field name -> name first used, over the renamings found. The vocabulary of names is bounded by ``limit``."""
    rows = changes.where("change = 'renamed'").groupBy("old_name", "field_name").count().orderBy(F.desc("count"), "old_name", "field_name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} pairs of field names")
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    uses: Counter = Counter()
    for r in rows:
        uses[r.old_name] += r["count"]
        a, b = root(r.old_name), root(r.field_name)
        core_a, core_b = a in CORE_FIELDS, b in CORE_FIELDS
        if a == b or core_a and core_b:
            continue
        keep, drop = (a, b) if core_a or not core_b and (uses[a], b) >= (uses[b], a) else (b, a)
        parent[drop] = keep
    return {x: root(x) for x in list(parent) if root(x) != x}


def tags_text(tags: list[tuple[str, str]]) -> str:
    return ",".join(f"{k}={v}" for k, v in tags)


def crc_of(tags: list[tuple[str, str]]) -> int:
    return zlib.crc32(tags_text(tags).encode())


def time_ms(v: object) -> int | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return int(v) if -(2**63) <= v < 2**63 else None
    s = str(v).strip()
    if re.fullmatch(r"-?\d+(\.\d+)?", s):
        return time_ms(float(s))
    try:
        at = dt.datetime.fromisoformat(s)
        return ((at if at.tzinfo else at.replace(tzinfo=dt.UTC)) - EPOCH) // dt.timedelta(milliseconds=1)
    except ValueError:
        pass
    t = pd.to_datetime(s, utc=True, errors="coerce")
    return None if pd.isna(t) else int(t.value // 1_000_000)


def number(v: object) -> float | None:
    """A double, rounded where it has to be."""
    try:
        return None if isinstance(v, bool) else float(v)
    except (TypeError, ValueError, OverflowError):
        return None


def whole(v: object) -> int | None:
    """The 64-bit whole number that a number or text (also ``0x...``) is, if it is one."""
    if isinstance(v, str):
        s = v.strip()
        try:
            v = int(s, 16) if re.fullmatch(r"0[xX][0-9a-fA-F]+", s) else int(s)
        except ValueError:
            v = fraction(s)
    if isinstance(v, bool) or not isinstance(v, (int, float)) or isinstance(v, float) and not v.is_integer():
        return None
    v = int(v)
    return v if -(2**63) <= v < 2**63 else None


def fraction(v: object) -> float | None:
    """The double that a number or text is; whole numbers that no double holds are None."""
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    try:
        x = float(v)
    except (ValueError, OverflowError):
        return None
    if isinstance(v, str) and re.fullmatch(r"\s*[+-]?\d+\s*", v):
        v = int(v)
    return None if isinstance(v, int) and int(x) != v else x


def truth(v: object) -> bool | None:
    return v if isinstance(v, bool) else {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else None


def as_text(v: object) -> str:
    """One text for a value: whole numbers without fraction, true and false in lower case, the rest as JSON with sorted names."""
    if isinstance(v, str):
        return v
    return json.dumps(int(v) if isinstance(v, float) and v.is_integer() else v, sort_keys=True)


def paired(v: object) -> str | None:
    """Label pairs in any spelling as a JSON object of texts; None if that would lose something."""
    flat = v.values() if isinstance(v, dict) else [y for x in v for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())] if isinstance(v, list) else ()
    if any(isinstance(x, (dict, list)) for x in flat):
        return None
    pairs = sorted((k, as_text(x)) for k, x in v.items() if x is not None) if isinstance(v, dict) else pairs_of(v)
    return None if pairs is None or len({k for k, _ in pairs}) < len(pairs) else json.dumps(dict(pairs))


def nested(v: object) -> str | None:
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else None


CAST = {"boolean": truth, "integer": whole, "fraction": fraction, "string": as_text, "pairs": paired, "nested": nested}


def form_of(v: object) -> str:
    """What a value can be cast to, finer than its JSON type; texts begin with ``text``."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        w = whole(v)
        return ("integer" if abs(w) <= 2**53 else "big") if w is not None else "fraction" if isinstance(v, float) else "huge"
    if isinstance(v, str):
        head = v.lstrip()[:1]
        if head in NUMERIC and head:
            w = whole(v)
            if w is not None:
                return "text integer" if abs(w) <= 2**53 else "text big"
            if fraction(v) is not None:
                return "text fraction"
        if truth(v) is not None:
            return "text boolean"
        return "text pairs" if paired(v) is not None else "text nested" if nested(v) is not None else "text"
    if isinstance(v, dict):  # as ``paired`` would answer, without making its text
        return "nested" if any(isinstance(x, (dict, list)) for x in v.values()) else "pairs"
    return "pairs" if paired(v) is not None else "nested"


def target_type(forms: dict[str, int]) -> str:
    """The type to cast a field to: that of most values, texts counting as what they spell.

    Texts that spell numbers stay texts where the field has no value of such a type; where less than half
    of the values can be cast to any other type, everything becomes text, which any value can.
    """
    t = Counter(forms)

    def both(*kinds: str) -> int:
        return sum(t[k] + t[f"text {k}"] for k in kinds)

    able = {}
    if t["boolean"]:
        able["boolean"] = both("boolean")
    if t["integer"] or t["big"] or t["fraction"]:
        # a double doesn't hold every whole number beyond 2**53
        kind = "fraction" if both("fraction") > both("big") else "integer"
        able[kind] = both("integer", "fraction" if kind == "fraction" else "big")
    if t["pairs"] or t["nested"]:
        able["pairs"] = both("pairs")
        able["nested"] = t["pairs"] + both("nested")
        del able["nested" if able["pairs"] >= able["nested"] else "pairs"]
    best = max(sorted(able), key=lambda k: able[k], default="string")
    return best if best != "string" and 2 * able[best] >= sum(t.values()) else "string"


def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each field has each form, of whole profiles."""
    for b in batches:
        n: Counter = Counter()
        for p in b["profile"]:
            for name, f in json.loads(p).items():
                for form, k in f["forms"].items():
                    n[name, form] += k
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["field", "form", "n"])


def target_types(profiles: DataFrame, names: dict[str, str], limit: int = 100_000) -> dict[str, str]:
    """Canonical field beside the core ones -> type to cast it to, over all files. The vocabulary is bounded by ``limit``."""
    rows = profiles.select("profile").mapInPandas(tallied, "field string, form string, n bigint").groupBy("field", "form").agg(F.sum("n").alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} forms of fields")
    forms: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        forms[names.get(r.field, r.field)][r.form] += r.n
    return {k: target_type(forms[k]) for k in sorted(forms) if k not in CORE_FIELDS}


def columns_of(fields: Iterable[str]) -> dict[str, str]:
    """Field -> column. Columns differ in more than case: of fields that don't, and of those named as a fixed column, the later get a number."""
    taken = {c.split()[0].lower() for c in TABLE.split(", ")} | {"extra"}
    out = {}
    for f in sorted(fields):
        c, n = f or "_", 1
        while c.lower() in taken:
            n += 1
            c = f"{f}_{n}"
        taken.add(c.lower())
        out[f] = c
    return out


def under(names: dict[str, str], o: dict) -> tuple[dict, dict]:
    """A record under canonical names, and the fields whose name was taken, under their own: the first name of a field comes first."""
    out: dict = {}
    also: dict = {}
    for k, v in sorted(o.items(), key=lambda kv: kv[0] in names):
        if v is not None:
            if names.get(k, k) in out:
                also[k] = v
            else:
                out[names.get(k, k)] = v
    return out, also


def united(names: dict[str, str], targets: dict[str, str], schema: pa.Schema):
    cast = [(k, CAST[t]) for k, t in targets.items()]

    core = [("timestamp", time_ms), ("value", number), ("series_id", whole), ("labels_crc32", whole), ("tags", pairs_of)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for f, r, p in zip(*(b.column(k).to_pylist() for k in ("file_id", "row_no", "payload"))):
                o = readable(p)
                if o is None:
                    continue
                o, also = under(names, o)
                got = {k: c(o[k]) for k, c in (*core, *cast) if k in o}
                crc, tags = got.get("labels_crc32"), got.get("tags")
                if tags is not None:
                    got["tags"] = tags = tags_text(tags)
                if crc is not None:
                    got["labels_crc32"] = crc = crc % 2**32
                ok = None if crc is None or tags is None else crc == zlib.crc32(tags.encode())
                left = [k for k in o if got.get(k) is None]
                extra = json.dumps(also | {k: o[k] for k in left}, sort_keys=True) if left or also else "{}"
                for column, v in zip(out, (f, r, *(got.get(k) for k, _ in core), ok, *(got.get(k) for k, _ in cast), extra)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return run


def one_table(blocks: DataFrame, changes: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """All readable records once, fields under their first names, tags sorted ``k=v`` and checksums unsigned.

    Every further field is a column of its one type; ``extra`` holds, as JSON, only the values that can't be
    cast to their field's type. The columns depend on the data, so the profiles are read for them at once.
    """
    names = canonical_names(changes)
    targets = target_types(file_profiles(blocks) if profiles is None else profiles, names)
    schema = StructType.fromDDL(TABLE)
    for field, column in columns_of(targets).items():
        schema = schema.add(column, COLUMN[targets[field]])
    schema = schema.add("extra", StringType())
    rows = blocks.where(F.col("file_id").isNotNull() & F.col("row_no").isNotNull() & F.col("payload").isNotNull())
    once = rows.groupBy("file_id", "row_no").agg(F.max_by("payload", F.struct(F.length("payload"), "payload")).alias("payload"))
    return once.mapInArrow(united(names, targets, to_arrow_schema(schema)), schema)
