"""The validating scan of raw JSON lines: a ladder of checks gives each line a record or a quarantine reason; identical
records and colliding keys are settled across lines; accepted events are sealed by a hash chain for each source."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canon
from ..operators.series import with_neighbours
from ..session import ship, written

#: Members of a raw record, keys that only ground truth may have, and the limits of a line.
MEMBERS = ("attrs", "event_type", "seq", "source_id", "t_evt_ns")
FORBIDDEN, FORBIDDEN_PREFIX = ("label", "is_attack", "scenario", "truth"), "__truth"
MAX_LINE, MAX_ATTRS, MAX_KEY, MAX_VALUE, MAX_TYPE = 65_536, 64, 64, 1024, 64
SNAKE = re.compile(r"^[a-z][a-z0-9_]*$")
DOTTED = re.compile(r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$")


class LabelImpurity(Exception):
    """Ground truth in the telemetry: the run stops."""


@dataclass(frozen=True)
class Limits:
    line: int = MAX_LINE
    attrs: int = MAX_ATTRS
    key: int = MAX_KEY
    value: int = MAX_VALUE
    event_type: int = MAX_TYPE
    #: A run over more lines is refused; None: no limit.
    records: int | None = None


@dataclass(frozen=True)
class Source:
    source_id: str
    integrity: str = "CHAINED"
    emits: tuple[str, ...] = field(default=())


def impure(key: str) -> bool:
    return key in FORBIDDEN or key.startswith(FORBIDDEN_PREFIX)


def parse_line(raw: bytes, sources: dict[str, tuple[str, ...]], limits: Limits) -> tuple[dict | None, str | None, str | None]:
    """(record, reason, detail): the first check that fails gives the reason."""
    if not raw:
        return None, "SCHEMA", "empty_line"
    if len(raw) > limits.line:
        return None, "LIMIT", "line_too_long"
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None, "ENCODING", "invalid_utf8"
    try:
        value = canon.loads(text)
    except canon.CanonError as e:
        return None, "SCHEMA", e.reason
    if not isinstance(value, dict):
        return None, "SCHEMA", "not_object"
    attrs = value.get("attrs")
    if any(map(impure, [*value, *(attrs if isinstance(attrs, dict) else ())])):
        return None, "IMPURE", "label"
    if tuple(sorted(value)) != MEMBERS:
        return None, "SCHEMA", "member_set"
    source, kind, seq = value["source_id"], value["event_type"], value["seq"]
    if not isinstance(source, str) or not SNAKE.match(source.removeprefix("src:")):
        return None, "SCHEMA", "source_id_form"
    source = source.removeprefix("src:")
    if source not in sources:
        return None, "SOURCE", "source_undeclared"
    if not isinstance(kind, str) or not DOTTED.match(kind):
        return None, "SCHEMA", "event_type_form"
    if len(kind.encode()) > limits.event_type:
        return None, "LIMIT", "event_type_too_long"
    if sources[source] and kind not in sources[source]:
        return None, "SOURCE", "event_type_undeclared"
    if isinstance(seq, bool) or not isinstance(seq, int):
        return None, "SCHEMA", "seq_form"
    if not 0 <= seq <= canon.U32:
        return None, "SCHEMA", "seq_width"
    try:
        t = canon.decimal(value["t_evt_ns"])
    except canon.CanonError as e:
        return None, "SCHEMA", e.reason
    if not isinstance(attrs, dict):
        return None, "SCHEMA", "attrs_form"
    if len(attrs) > limits.attrs:
        return None, "LIMIT", "attr_count"
    for k, v in attrs.items():
        if not SNAKE.match(k):
            return None, "SCHEMA", "attr_key_form"
        if len(k) > limits.key:
            return None, "LIMIT", "attr_key_too_long"
        if not isinstance(v, str):
            return None, "SCHEMA", "attr_value_form"
        if len(v.encode()) > limits.value:
            return None, "LIMIT", "attr_value_too_long"
        if not canon.is_text(v):
            return None, "SCHEMA", "not_nfc"
    if canon.dumps(value) != text:
        return None, "SCHEMA", "reserialise_differs"
    return {"source_id": source, "seq": seq, "t_evt_ns": t, "event_type": kind, "attrs": attrs}, None, None


PARSED = T.StructType([
    T.StructField("line_no", T.LongType()), T.StructField("raw", T.BinaryType()), T.StructField("source_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("t_evt_ns", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType()),
])


def parse(lines: DataFrame, sources: list[Source], limits: Limits = Limits()) -> DataFrame:
    """lines: (line_no, raw binary). Adds the record's columns, or reason and detail."""
    ship(lines.sparkSession)
    declared = {s.source_id: s.emits for s in sources}

    def run(batches):
        for b in batches:
            rows = [parse_line(x or b"", declared, limits) for x in b.column(1).to_pylist()]
            get = lambda k, kind: pa.array([r[0] and r[0][k] for r in rows], kind)
            attrs = pa.array([r[0] and sorted(r[0]["attrs"].items()) for r in rows], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), get("source_id", pa.string()), get("seq", pa.int64()), get("t_evt_ns", pa.int64()), get("event_type", pa.string()), attrs, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=PARSED.names)

    return lines.select("line_no", "raw").mapInArrow(run, PARSED)


def settle(parsed: DataFrame) -> DataFrame:
    """Across lines: of identical records the first stays, the others are duplicates; of different records with one
    (source, seq) none stays. Counts are pre-aggregated by the record's digest, so a line repeated without end is no
    hot group."""
    known = parsed.withColumn("\0digest", F.when(F.col("reason").isNull(), F.sha2("raw", 256)))
    records = known.where(F.col("reason").isNull()).groupBy("\0digest").agg(F.min("line_no").alias("\0first"), F.first("source_id").alias("s"), F.first("seq").alias("q"))
    shared = records.groupBy("s", "q").agg(F.count("*").alias("\0n")).where("`\0n` > 1")
    records = records.join(shared, ["s", "q"], "left").select("\0digest", "\0first", F.col("\0n").isNotNull().alias("\0clash"))
    met = known.join(records, "\0digest", "left")
    again = F.col("reason").isNull() & (F.col("line_no") != F.col("\0first"))
    clash = F.col("reason").isNull() & F.col("\0clash")
    reason = F.when(again, "DUPLICATE").when(clash, "COLLISION").otherwise(F.col("reason"))
    detail = F.when(again, "identical_line").when(clash, "seq_collision").otherwise(F.col("detail"))
    return met.withColumns({"reason": reason, "detail": detail}).select(*parsed.columns)


def ingest(spark: SparkSession, lines: DataFrame, sources: list[Source], limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine). Over ``records`` lines the run is refused and nothing is cut off; ground truth stops it.
    Lines are parsed once: what the parser says is written, and read from there."""
    done = written(settle(written(parse(lines, sources, limits))))
    state = done.agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "IMPURE").alias("impure")).collect()[0]
    if state.impure:
        raise LabelImpurity(f"{state.impure} lines carry ground truth")
    if limits.records is not None and state.n > limits.records:
        raise ValueError(f"{state.n} lines; the limit is {limits.records}")
    accepted = done.where(F.col("reason").isNull()).select("source_id", "seq", "t_evt_ns", "event_type", "attrs", F.sha2("raw", 256).alias("record_id"))
    return accepted, done.where(F.col("reason").isNotNull()).select("line_no", "reason", "detail", "source_id", F.sha2("raw", 256).alias("record_id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of text files; the number orders lines within the scan. A file whose last line doesn't end in a line
    feed is refused: that line may have been cut off."""
    ends = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).where(F.substring("content", -1, 1) != F.lit(b"\n")).select("path").limit(1).collect()
    if ends:
        raise ValueError(f"the last line of {ends[0].path} has no line feed")
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").cast("binary").alias("raw"))


BUNDLE = T.StructType([T.StructField(n, t) for n, t in (("line_no", T.LongType()), ("source_id", T.StringType()), ("seq", T.LongType()), ("t_evt_ns", T.LongType()), ("event_type", T.StringType()), ("attrs", T.MapType(T.StringType(), T.StringType())), ("record_id", T.StringType()), ("problem", T.StringType()))])


def bundle_line(raw: bytes) -> tuple[dict | None, str | None]:
    """(event, problem) of a line of a bundle: it must be its own canonical form, and its id that of its record."""
    try:
        event = canon.loads(raw.decode("utf-8"))
    except (canon.CanonError, UnicodeDecodeError):
        return None, "not_json"
    if not isinstance(event, dict) or set(event) != {*MEMBERS, "record_id"}:
        return None, "members"
    if canon.line(event).rstrip(b"\n") != raw:
        return None, "reserialise_differs"
    record = canon.line({k: event[k] for k in MEMBERS}).rstrip(b"\n")
    return event, None if hashlib.sha256(record).hexdigest() == event["record_id"] else "record_id"


def read_bundle(lines: DataFrame) -> DataFrame:
    """Events of a bundle's (line_no, raw), strictly: any line that isn't canonical, whose id doesn't follow from it, or that
    doesn't come after its predecessor by (source_id, seq) makes the read fail."""
    ship(lines.sparkSession)

    def run(batches):
        for b in batches:
            rows = [bundle_line(x) for x in b.column(1).to_pylist()]
            get = lambda name, kind: pa.array([r and r[name] for r, _ in rows], kind)
            times = pa.array([int(r["t_evt_ns"]) if r else None for r, _ in rows], pa.int64())
            attrs = pa.array([list(r["attrs"].items()) if r else None for r, _ in rows], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), get("source_id", pa.string()), get("seq", pa.int64()), times, get("event_type", pa.string()), attrs, get("record_id", pa.string()), pa.array([p for _, p in rows], pa.string())], names=BUNDLE.names)

    read = written(lines.select("line_no", "raw").mapInArrow(run, BUNDLE))
    near = with_neighbours(read.withColumn("all", F.lit(0)), ["all"], ["line_no"], ["source_id", "seq"], width=100_000)
    after = F.struct("source_id", "seq") > F.struct("prev_source_id", "prev_seq")
    odd = near.withColumn("problem", F.coalesce("problem", F.when(F.col("prev_source_id").isNotNull() & ~after, "order"))).where(F.col("problem").isNotNull())
    first = odd.orderBy("line_no").limit(1).collect()
    if first:
        raise ValueError(f"line {first[0].line_no} of the bundle: {first[0].problem}")
    return read.drop("line_no", "problem")


def write_bundle(accepted: DataFrame) -> DataFrame:
    """(source_id, seq, raw): the canonical line of each accepted event; a bundle is these in order of (source_id, seq)."""
    ship(accepted.sparkSession)
    names = ("source_id", "seq", "t_evt_ns", "event_type", "attrs", "record_id")

    def run(batches):
        for b in batches:
            lines = [canon.line({"source_id": s, "seq": q, "t_evt_ns": str(t), "event_type": e, "attrs": dict(a or ()), "record_id": r}).rstrip(b"\n") for s, q, t, e, a, r in zip(*(b.column(i).to_pylist() for i in range(6)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.binary())], names=["source_id", "seq", "raw"])

    return accepted.select(*names).mapInArrow(run, "source_id string, seq long, raw binary")


def counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reason", "detail").agg(F.count("*").alias("n"))


def link(source: str, previous: str, record_id: str, seq: int) -> str:
    return hashlib.blake2b(json.dumps([source, previous, record_id, seq]).encode(), digest_size=32).hexdigest()


def seal(accepted: DataFrame) -> DataFrame:
    """Adds chain_prev and chain_hash: a fold along seq, so a source is one sequence of work whatever the machine. Rows
    stream through in order and none is held back; the state is one hash."""
    ship(accepted.sparkSession)
    n = int(accepted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = accepted.repartition(n, "source_id").sortWithinPartitions("source_id", "seq")
    names = accepted.columns
    schema = T.StructType(accepted.schema.fields + [T.StructField("chain_prev", T.StringType()), T.StructField("chain_hash", T.StringType())])
    si, qi, ri = (names.index(c) for c in ("source_id", "seq", "record_id"))

    def run(batches):
        source, last = None, ""
        for b in batches:
            prev, own = [], []
            for s, q, r in zip(b.column(si).to_pylist(), b.column(qi).to_pylist(), b.column(ri).to_pylist()):
                if s != source:
                    source, last = s, link(s, "genesis", "", 0)
                prev.append(last)
                last = link(s, last, r, q)
                own.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*names, "chain_prev", "chain_hash"])

    return ordered.mapInArrow(run, schema)


def verify_chain(sealed: DataFrame) -> DataFrame:
    """Rows whose link fails. Each needs only its predecessor's hash, so all are checked at once."""
    ship(sealed.sparkSession)
    near = with_neighbours(sealed, ["source_id"], ["seq"], ["chain_hash"], width=100_000)

    @F.pandas_udf("string")
    def expected(source, prev, record, seq):
        import pandas as pd

        return pd.Series([link(s, p, r, int(q)) for s, p, r, q in zip(source, prev, record, seq)])

    @F.pandas_udf("string")
    def genesis(source):
        import pandas as pd

        return pd.Series([link(s, "genesis", "", 0) for s in source])

    want = F.coalesce("prev_chain_hash", genesis("source_id"))
    return near.withColumn("want", want).where((F.col("chain_prev") != F.col("want")) | (F.col("chain_hash") != expected("source_id", "chain_prev", "record_id", "seq"))).drop("want", "prev_chain_hash")
