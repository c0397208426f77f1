"""Queries over the driver's tables, one for each operator, with the same in SQL.

Each entry of QUERIES takes (spark, sf_dir); ORACLES has the SQL by the same name.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import collections as c
from keyfold.functions import values as v
from keyfold.operators import enrich, fold, ingest, transition
from keyfold.operators.schema import Accept, Counter, GroupedMap, LastSeen, LatestBy, Retention, Schema, Stream, Transformer, WriteOnce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KEPT_TYPES = ("click", "view", "purchase")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the user as text, the time in nanoseconds and the arrival order."""
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").withColumns({"user": F.col("user_id").cast("string"), "nanos": nanos, "seq": F.struct(nanos, F.col("event_id"))})


#: Events as the SQL sees them.
EV = "WITH ev AS (SELECT *, user_id::VARCHAR AS usr, epoch_us(ts) * 1000 AS nanos FROM events), ad AS (SELECT * FROM ev WHERE event_type IN ('click', 'view', 'purchase')) "

ACCEPT = Accept(require=("user",), event_types=KEPT_TYPES, event_type_path="event_type")
_time = lambda r: r["nanos"]
_cents = lambda r: v.Value(F.round(r["value"].col * 100).cast("bigint"), "long")
_is = lambda kind: lambda r: v.equal(r["event_type"], v.lit(kind))

SESSION = Schema(
    aggregate="user",
    version=1,
    id_type="user_id",
    primary_key="{user}",
    accept=ACCEPT,
    fields={
        "last": LatestBy(comparator=_time, payload=lambda r: r["value"]),
        "first_type": WriteOnce(value=lambda r: r["event_type"]),
        "last_type": LastSeen(value=lambda r: r["event_type"]),
        "by_type": GroupedMap(key=lambda r: r["event_type"], value=LatestBy(comparator=_time, payload=_cents)),
        "n": Counter(),
        "purchases": Counter(when=_is("purchase")),
    },
)


def _schema(**fields) -> Schema:
    return Schema("user", 1, "user_id", "{user}", fields, ACCEPT)


def state(spark: SparkSession, sf_dir: str, schema: Schema = SESSION, where: str = "true") -> DataFrame:
    """The elided state of the admitted events."""
    return fold.elided(fold.fold(ingest.admitted(events(spark, sf_dir).where(where), schema), schema), schema)


# ------------------------------------------------------------------ admission and keys


@query(EV + "SELECT event_id, event_type FROM ad")
def admit_filter(spark, sf_dir):
    return ingest.admitted(events(spark, sf_dir), SESSION).select("event_id", "event_type")


@query(EV + "SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'admitted' ELSE 'filtered' END AS tag, count(*) AS n FROM ev GROUP BY 1")
def admit_tag(spark, sf_dir):
    return ingest.tag(events(spark, sf_dir), SESSION).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE NOT contains(event_type, 'err')")
def reject_contains(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.where(ingest.admit(Accept(require=("event_type",), reject_if_contains="err"), ingest.Record(rows.schema))).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def tenant_allow(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.where(ingest.admit(Accept(tenants=("BUILDING", "MACHINERY"), tenant_path="missing|c_mktsegment"), ingest.Record(rows.schema))).select("c_custkey")


@query("SELECT event_id, user_id::VARCHAR || '-' || event_type AS session_key FROM events")
def key_template(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("event_id", ingest.session_key("{user}-{event_type}", ingest.Record(rows.schema)).alias("session_key"))


@query("SELECT doc_id, coalesce(lang, source) AS picked FROM documents WHERE coalesce(lang, source) <> ''")
def alternation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    record = ingest.Record(rows.schema)
    return rows.where(ingest.admit(Accept(require=("absent|lang|source",)), record)).select("doc_id", record.first_text("absent|lang|source").alias("picked"))


# ------------------------------------------------------------------ fold


@query(EV + "SELECT usr AS session_key, arg_max(value, (nanos, event_id)) AS last_value, arg_min(event_type, (nanos, event_id)) AS first_type, count(*) AS event_count FROM ad GROUP BY usr")
def session_fold(spark, sf_dir):
    return state(spark, sf_dir, _schema(last=SESSION.fields["last"], first_type=SESSION.fields["first_type"], n=Counter())).select(
        "session_key", F.col("last.payload").alias("last_value"), "first_type", F.col("n").alias("event_count")
    )


@query(EV + "SELECT usr AS session_key, max(nanos) AS comparator, arg_max(value, (nanos, event_id)) AS payload FROM ad GROUP BY usr")
def latest_by(spark, sf_dir):
    return state(spark, sf_dir, _schema(last=SESSION.fields["last"])).select("session_key", "last.comparator", "last.payload")


@query(
    EV + """, g AS (SELECT usr, nanos, event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 0 END AS c, CASE WHEN event_type = 'purchase' THEN value END AS p FROM ad)
    SELECT usr AS session_key, arg_max_null(p, (c, nanos, event_id)) AS payload FROM g GROUP BY usr"""
)
def latest_by_erased(spark, sf_dir):
    """A comparator that does not parse is 0: any later record that the gate turns away erases the payload."""
    slot = LatestBy(comparator=lambda r: v.parse_time(r["event_type"]), payload=lambda r: r["value"], when=_is("purchase"))
    return state(spark, sf_dir, _schema(slot=slot)).select("session_key", "slot.payload")


@query(EV + "SELECT usr AS session_key, max(nanos) FILTER (event_type = 'purchase') AS comparator, arg_max(value, (nanos, event_id)) FILTER (event_type = 'purchase') AS payload FROM ad GROUP BY usr")
def latest_by_gated(spark, sf_dir):
    slot = LatestBy(comparator=_time, payload=lambda r: r["value"], when=_is("purchase"))
    return state(spark, sf_dir, _schema(slot=slot)).select("session_key", "slot.comparator", "slot.payload")


@query(EV + "SELECT usr AS session_key, event_type AS entry, max(nanos) AS comparator, arg_max(round(value * 100)::BIGINT, (nanos, event_id)) AS payload FROM ad GROUP BY ALL")
def grouped_map(spark, sf_dir):
    held = state(spark, sf_dir, _schema(by_type=SESSION.fields["by_type"]))
    return held.select("session_key", F.explode("by_type").alias("entry", "slot")).select("session_key", "entry", "slot.comparator", "slot.payload")


@query(EV + "SELECT usr AS session_key, arg_max(event_type, (nanos, event_id)) AS last_type FROM ad GROUP BY usr")
def last_seen(spark, sf_dir):
    return state(spark, sf_dir, _schema(last_type=SESSION.fields["last_type"])).select("session_key", "last_type")


@query(EV + "SELECT usr AS session_key, arg_min(event_type, (nanos, event_id)) AS first_type FROM ad GROUP BY usr")
def write_once(spark, sf_dir):
    return state(spark, sf_dir, _schema(first_type=SESSION.fields["first_type"])).select("session_key", "first_type")


@query(EV + "SELECT usr AS session_key, count(*) AS n, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchases FROM ad GROUP BY usr")
def counter(spark, sf_dir):
    return state(spark, sf_dir, _schema(n=Counter(), purchases=SESSION.fields["purchases"])).select("session_key", "n", "purchases")


def middle(rows: DataFrame) -> int:
    """The id half way between the least and the greatest one: an aggregate with a partial step."""
    return rows.agg(F.expr("cast((min(event_id) + max(event_id)) div 2 as bigint)")).first()[0] or 0


def two_batches(spark: SparkSession, sf_dir: str, schema: Schema = SESSION) -> DataFrame:
    """(session_key, old, new) of the second half of the events over the state of the first."""
    rows = events(spark, sf_dir)
    m = middle(rows)
    before = fold.fold(ingest.admitted(rows.where(F.col("event_id") <= m), schema), schema)
    after = fold.fold(ingest.admitted(rows.where(F.col("event_id") > m), schema), schema)
    return fold.merge(fold.elided(before, schema), after, schema)


#: The first and second half of the events.
HALVES = EV + ", mid AS (SELECT (min(event_id) + max(event_id)) // 2 AS m FROM ev), h1 AS (SELECT ad.* FROM ad, mid WHERE event_id <= m), h2 AS (SELECT ad.* FROM ad, mid WHERE event_id > m) "


@query(
    HALVES
    + """SELECT usr AS session_key, arg_max(value, (nanos, event_id)) AS last_value, arg_min(event_type, (nanos, event_id)) AS first_type, arg_max(event_type, (nanos, event_id)) AS last_type,
    count(*) AS n, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchases, count(DISTINCT event_type) AS n_entries FROM ad WHERE usr IN (SELECT usr FROM h2) GROUP BY usr"""
)
def merge_two_batches(spark, sf_dir):
    return two_batches(spark, sf_dir).select(
        "session_key", F.col("new.last.payload").alias("last_value"), "new.first_type", "new.last_type", "new.n", "new.purchases", F.size("new.by_type").cast("bigint").alias("n_entries")
    )


# ------------------------------------------------------------------ collections

def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as a state: a map by line number."""
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"user": F.col("l_orderkey").cast("string"), "line": F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "seq": F.struct("l_linenumber", "l_partkey", "l_suppkey"), "at": F.unix_micros(F.col("l_shipdate").cast("timestamp")), "cents": F.round(F.col("l_extendedprice") * 100).cast("bigint")}
    )
    slot = LatestBy(comparator=lambda r: r["at"], payload=lambda r: v.Value(F.struct("l_linenumber", "l_partkey", "cents", "l_returnflag"), "variant"))
    schema = Schema("order", 1, "order_id", "{user}", {"lines": GroupedMap(key=lambda r: r["line"], value=slot)})
    return fold.elided(fold.fold(ingest.admitted(rows, schema), schema), schema).withColumn("items", c.payloads(F.col("lines")))


_LINES = """WITH x AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS shipped, round(l_extendedprice * 100)::BIGINT AS cents, l_partkey, l_suppkey, l_returnflag FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY shipped DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM x), l AS (SELECT * FROM r WHERE rn = 1) """


@query(_LINES + "SELECT l_orderkey::VARCHAR AS session_key, arg_max(cents, (shipped, -l_linenumber)) AS latest_cents, arg_min(cents, (shipped, l_linenumber)) AS first_cents FROM l GROUP BY l_orderkey")
def reduce_latest_first(spark, sf_dir):
    return order_lines(spark, sf_dir).select("session_key", c.latest(F.col("lines"))["cents"].alias("latest_cents"), c.first(F.col("lines"))["cents"].alias("first_cents"))


@query(_LINES + "SELECT l_orderkey::VARCHAR AS session_key, arg_max(l_linenumber, (cents, -l_linenumber)) AS dearest, arg_min(l_linenumber, (cents, l_linenumber)) AS cheapest FROM l GROUP BY l_orderkey")
def reduce_by_field(spark, sf_dir):
    rows, cents = order_lines(spark, sf_dir), lambda p: p["cents"]
    return rows.select("session_key", c.latest_by(F.col("items"), cents)["l_linenumber"].alias("dearest"), c.first_by(F.col("items"), cents)["l_linenumber"].alias("cheapest"))


@query(
    _LINES
    + "SELECT l_orderkey::VARCHAR AS session_key, count(*) AS n, sum(cents)::BIGINT AS total, min(cents) AS least, max(cents) AS most, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_returnflag = 'R') AS returned, string_agg(cents::VARCHAR, ',' ORDER BY l_linenumber) AS listed FROM l GROUP BY l_orderkey"
)
def reduce_numbers(spark, sf_dir):
    cents, items = (lambda p: p["cents"]), F.col("items")
    return order_lines(spark, sf_dir).select(
        "session_key", c.count(F.col("lines")).alias("n"), c.total_long(items, cents).alias("total"), c.least(items, cents).alias("least"), c.greatest(items, cents).alias("most"),
        c.count_distinct(items, lambda p: p["l_partkey"]).alias("parts"), c.count(c.only(items, lambda p: p["l_returnflag"] == "R")).alias("returned"),
        F.array_join(F.transform(c.list_of(items), lambda p: p["cents"].cast("string")), ",").alias("listed"),
    )


@query(_LINES + "SELECT l_orderkey::VARCHAR AS session_key, lpad(l_linenumber::VARCHAR, 3, '0') AS entry, cents FROM l")
def explode_map(spark, sf_dir):
    return order_lines(spark, sf_dir).select("session_key", F.explode("lines").alias("entry", "slot")).select("session_key", "entry", "slot.payload.cents")


@query(_LINES + "SELECT l_orderkey::VARCHAR AS session_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place, cents FROM l")
def explode_array(spark, sf_dir):
    return order_lines(spark, sf_dir).select("session_key", F.posexplode("items").alias("place", "item")).select("session_key", F.col("place").cast("bigint").alias("place"), "item.cents")


# ------------------------------------------------------------------ scalars


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_nation(spark, sf_dir):
    dimension = table(spark, sf_dir, "nation").select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return enrich.lookup(rows, dimension, "nation", v.column("c_nationkey", "int"), "nation").select("c_custkey", "nation")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def parse_json_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", v.as_long(v.get(v.parse_json(v.column("props", "string")), "k")).alias("k"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events")
def parse_time_nanos(spark, sf_dir):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select("event_id", v.parse_time(v.Value(text, "string")).col.alias("nanos"))


@query("SELECT event_id, (epoch_us(ts) // 1000000) * 1000000000 AS s, epoch_us(ts) * 1000 AS us FROM events")
def parse_time_units(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = v.Value(F.floor(micros / 1000000).cast("string"), "string")
    return table(spark, sf_dir, "events").select("event_id", v.parse_time(seconds, "epoch_seconds").col.alias("s"), v.parse_time(v.Value(micros, "long"), "epoch_micros").col.alias("us"))


@query("SELECT o_orderkey, (o_orderkey - 50000) - ((((o_orderkey - 50000) % 7) + 7) % 7) AS b, o_orderkey AS same FROM orders")
def bucket_floor(spark, sf_dir):
    key = v.Value(F.col("o_orderkey") - 50000, "long")
    return table(spark, sf_dir, "orders").select("o_orderkey", v.bucket(key, v.lit(7)).col.alias("b"), v.bucket(v.column("o_orderkey", "bigint"), v.lit(0)).col.alias("same"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::BIGINT AS half FROM lineitem")
def round_half_even(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.round_even(v.Value(F.col("l_quantity") / 2, "double")).col.alias("half"))


@query(
    """SELECT s_suppkey, 'supplier#' AS lowered, s_name AS trimmed, s_name || '/' || s_nationkey::VARCHAR || '/true' AS joined,
    CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS meant, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE s_nationkey::VARCHAR END AS first_meant FROM supplier"""
)
def texts(spark, sf_dir):
    name = v.column("s_name", "string")
    odd = v.Value(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise(F.lit(" UnKnown ")), "string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", v.lower(v.lit("SUPPLIER#")).col.alias("lowered"), v.trim(v.Value(F.concat(F.lit(" \t"), "s_name", F.lit("\n ")), "string")).col.alias("trimmed"),
        v.concat(name, v.lit("/"), v.column("s_nationkey", "int"), v.lit("/"), v.lit(True)).col.alias("joined"), v.meaningful(odd).col.alias("meant"),
        v.coalesce(odd, v.Value(F.col("s_nationkey").cast("string"), "string")).col.alias("first_meant"),
    )


@query(
    """SELECT p_partkey, p_size > 25 AS gt, p_size >= 25 AS ge, p_size < 25 AS lt, p_size <= 25 AS le, p_size = 25 AS eq, p_size <> 25 AS ne, false AS text_eq, false AS text_lt, true AS null_eq,
    (p_size > 10 AND p_retailprice > 1000) AS both, (p_size > 45 OR p_retailprice > 1500) AS either, NOT (p_size > 25) AS negated, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS chosen FROM part"""
)
def predicates(spark, sf_dir):
    size, price, n = v.column("p_size", "int"), v.column("p_retailprice", "double"), v.lit(25)
    text = v.Value(F.col("p_size").cast("string"), "string")
    big = v.compare(">", size, n)
    return table(spark, sf_dir, "part").select(
        "p_partkey", *(v.compare(op, text, n).col.alias(name) for op, name in ((">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"))),
        v.equal(size, v.lit(25.0)).col.alias("eq"), v.unequal(size, n).col.alias("ne"), v.equal(text, size).col.alias("text_eq"), v.compare("<", v.column("p_name", "string"), n).col.alias("text_lt"),
        v.equal(v.lit(None), v.lit(None)).col.alias("null_eq"), v.both(v.compare(">", size, v.lit(10)), v.compare(">", price, v.lit(1000))).col.alias("both"),
        v.either(v.compare(">", size, v.lit(45)), v.compare(">", price, v.lit(1500))).col.alias("either"), v.negate(big).col.alias("negated"),
        v.choose(big, v.column("p_brand", "string"), v.column("p_type", "string")).col.alias("chosen"),
    )


@query("SELECT p_partkey, p_size % 4 <> 0 AS num, p_size % 4 <> 0 AS txt, true AS zero_text, false AS nothing FROM part")
def truthiness(spark, sf_dir):
    left = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select(
        "p_partkey", v.truthy(v.Value(left.cast("bigint"), "long")).alias("num"), v.truthy(v.Value(F.when(left == 0, "").otherwise("x"), "string")).alias("txt"), v.truthy(v.lit("0")).alias("zero_text"), v.truthy(v.lit(None)).alias("nothing")
    )


# ------------------------------------------------------------------ deltas

_LAST = {"last_type": lambda s: s.value("last_type"), "n": lambda s: s.value("n")}
USERS = Stream("users", "user-events", columns=_LAST, key=lambda s: s.value("first_type"), gate=lambda s: v.compare(">=", s.value("n"), v.lit(3)))
ENTRIES = Stream("entries", "entry-events", explode="by_type", each={"cents": lambda s: s.each("payload")}, common={"first": lambda s: s.value("first_type")})
CLOSING = Stream("closing", "closing-events", columns=_LAST, gate=lambda s: v.compare("<", s.value("n"), v.lit(40)))

#: User states after the first half and at the end, of the users of the second half.
STATES = HALVES + """, o AS (SELECT usr, arg_max(event_type, (nanos, event_id)) AS last_type, arg_min(event_type, (nanos, event_id)) AS first_type, count(*) AS n FROM h1 GROUP BY usr),
nw AS (SELECT usr, arg_max(event_type, (nanos, event_id)) AS last_type, arg_min(event_type, (nanos, event_id)) AS first_type, count(*) AS n FROM ad WHERE usr IN (SELECT usr FROM h2) GROUP BY usr),
j AS (SELECT nw.usr, nw.last_type AS nl, nw.first_type AS nf, nw.n AS nn, o.last_type AS ol, o.first_type AS of_, o.n AS on_ FROM nw LEFT JOIN o USING (usr)) """


def _delta_sql(gate: str, key: str) -> str:
    new, old = gate.format("nn"), f"coalesce({gate.format('on_')}, false)"
    return (
        STATES
        + f"""SELECT usr AS session_key, 1 AS sign, {key.format('nf')} AS key, '{{"last_type":"' || nl || '","n":' || nn || ',"sign_flag":1}}' AS payload FROM j WHERE {new} AND ({old} IS FALSE OR (nl, nn) IS DISTINCT FROM (ol, on_))
        UNION ALL SELECT usr, -1, {key.format('of_')}, '{{"last_type":"' || ol || '","n":' || on_ || ',"sign_flag":-1}}' FROM j WHERE {old} AND (NOT ({new}) OR (nl, nn) IS DISTINCT FROM (ol, on_))"""
    )


@query(_delta_sql("{} >= 3", "{}"))
def delta_pair(spark, sf_dir):
    return transition.render(two_batches(spark, sf_dir), USERS, 0).select("session_key", "sign", "key", "payload")


@query(_delta_sql("{} < 40", "''"))
def delta_close(spark, sf_dir):
    return transition.render(two_batches(spark, sf_dir), CLOSING, 0).select("session_key", "sign", "key", "payload")


@query(
    HALVES
    + """, o AS (SELECT usr, event_type, arg_max(round(value * 100)::BIGINT, (nanos, event_id)) AS c FROM h1 GROUP BY ALL),
    n AS (SELECT usr, event_type, arg_max(round(value * 100)::BIGINT, (nanos, event_id)) AS c FROM ad WHERE usr IN (SELECT usr FROM h2) GROUP BY ALL)
    SELECT usr AS session_key, event_type AS row_id, 1 AS sign, n.c AS cents FROM n LEFT JOIN o USING (usr, event_type) WHERE n.c IS DISTINCT FROM o.c
    UNION ALL SELECT usr, event_type, -1, o.c FROM n JOIN o USING (usr, event_type) WHERE n.c IS DISTINCT FROM o.c"""
)
def delta_explode(spark, sf_dir):
    rows = transition.render(two_batches(spark, sf_dir), ENTRIES, 0)
    return rows.select("session_key", "row_id", "sign", F.get_json_object("payload", "$.cents").cast("bigint").alias("cents"))


@query(EV + "SELECT usr AS session_key, event_type AS row_id, 1::BIGINT AS net FROM ad GROUP BY ALL")
def delta_net(spark, sf_dir):
    """Deltas of both batches add up to the rows of the final state."""
    rows, schema = events(spark, sf_dir), SESSION
    first = fold.fold(ingest.admitted(rows.where(F.col("event_id") <= middle(rows)), schema), schema)
    nothing = fold.elided(first, schema).where("false")
    both = transition.render(fold.merge(nothing, first, schema), ENTRIES, 0).union(transition.render(two_batches(spark, sf_dir), ENTRIES, 0))
    return both.groupBy("session_key", "row_id").agg(F.sum("sign").cast("bigint").alias("net")).where("net <> 0")


@query(STATES + "SELECT usr AS session_key, nn AS at FROM j WHERE 20 * 86400 - nn * 86400 < 5 * 86400")
def retention(spark, sf_dir):
    stream = Stream("kept", "kept", columns={"at": lambda s: v.Value(F.col(f"{s.base}.n") * 86400, "long")}, retention=Retention(5, "at"))
    states = two_batches(spark, sf_dir).withColumn("old", F.when(F.lit(False), F.col("old")))
    return transition.render(states, stream, 20 * 86400).select("session_key", (F.get_json_object("payload", "$.at").cast("bigint") / 86400).cast("bigint").alias("at"))


@query(
    """WITH st AS (SELECT s_nationkey, count(*) AS n, max(s_suppkey) AS last FROM supplier GROUP BY 1)
    SELECT s_nationkey::VARCHAR AS session_key, 1 AS sign, '{"last":' || last || ',"n":' || n || ',"nation":"' || n_name || '","sign_flag":1}' AS payload FROM st JOIN nation ON n_nationkey = s_nationkey"""
)
def delta_lookup(spark, sf_dir):
    """Deltas with a look-up in an enrichment table."""
    rows = table(spark, sf_dir, "supplier").withColumns({"user": F.col("s_nationkey").cast("string"), "seq": F.col("s_suppkey")})
    schema = Schema("nation", 1, "nationkey", "{user}", {"nation": LastSeen(value=lambda r: r["user"]), "last": LatestBy(comparator=lambda r: r["s_suppkey"], payload=lambda r: r["s_suppkey"]), "n": Counter()})
    local = fold.fold(ingest.admitted(rows, schema), schema)
    dimension = table(spark, sf_dir, "nation").select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    stream = Stream("suppliers", "suppliers", columns={"nation": lambda s: s.lookup("name"), "last": lambda s: s.value("last.payload"), "n": lambda s: s.value("n")}, lookups={"name": ("nation", lambda s: s.value("nation"))})
    states = fold.merge(fold.elided(local, schema).where("false"), local, schema)
    return transition.render(states, stream, 0, enrichment=dimension).select("session_key", "sign", "payload")


def _id_sql(*parts: str) -> str:
    return "md5(" + " || ".join(f"length({p}) || ':' || {p}" for p in parts) + ")"


_IDS = ("'users'", "'user-events'", "usr", "''", "''", "''", "''")


@query(
    STATES
    + f""", p AS (SELECT *, nn >= 3 AS new_open, coalesce(on_ >= 3, false) AS old_open, (nl, nn) IS DISTINCT FROM (ol, on_) AS changed,
    '{{"last_type":"' || nl || '","n":' || nn || ',"sign_flag":1}}' AS plus, '{{"last_type":"' || ol || '","n":' || on_ || ',"sign_flag":-1}}' AS minus FROM j),
    legs AS (SELECT usr, 1 AS sign, '+1' AS signed, plus AS payload, plus AS anchor FROM p WHERE new_open AND (NOT old_open OR changed)
    UNION ALL SELECT usr, -1, '-1', minus, CASE WHEN new_open THEN plus ELSE minus END FROM p WHERE old_open AND (NOT new_open OR changed))
    SELECT usr AS session_key, sign, {_id_sql(*_IDS, "payload", "signed")} AS event_id, {_id_sql(*_IDS, "anchor")} AS correlation_id FROM legs"""
)
def event_ids(spark, sf_dir):
    """Ids of the deltas: one for each delta, shared correlation in a pair."""
    return transition.render(two_batches(spark, sf_dir), USERS, 0).select("session_key", "sign", "event_id", "correlation_id")


@query()
def event_ids_exact(spark, sf_dir):
    """The same with the 128-bit FNV hash."""
    return transition.render(two_batches(spark, sf_dir), USERS, 0, exact_ids=True).select("session_key", "sign", "event_id", "correlation_id")


@query(
    """WITH st AS (SELECT o_custkey, count(*) AS n_orders, arg_max(o_orderpriority, (epoch_us(o_orderdate), o_orderkey)) AS last_priority FROM orders GROUP BY 1)
    SELECT o_custkey::VARCHAR AS session_key, o_orderkey::VARCHAR AS row_id, round(o_totalprice * 100)::BIGINT AS cents, last_priority, n_orders FROM orders JOIN st USING (o_custkey)"""
)
def customer_order_rows(spark, sf_dir):
    """Sessions per customer with an exploded row for each order."""
    rows = table(spark, sf_dir, "orders").withColumns(
        {"user": F.col("o_custkey").cast("string"), "order": F.col("o_orderkey").cast("string"), "at": F.unix_micros(F.col("o_orderdate").cast("timestamp")), "seq": F.col("o_orderkey"), "cents": F.round(F.col("o_totalprice") * 100).cast("bigint")}
    )
    schema = Schema("customer", 1, "custkey", "{user}", {
        "orders": GroupedMap(key=lambda r: r["order"], value=LatestBy(comparator=lambda r: r["at"], payload=lambda r: r["cents"])),
        "last": LatestBy(comparator=lambda r: r["at"], payload=lambda r: r["o_orderpriority"]),
        "n": Counter(),
    })
    local = fold.fold(ingest.admitted(rows, schema), schema)
    stream = Stream("orders", "orders", explode="orders", common={"last_priority": lambda s: s.value("last.payload"), "n_orders": lambda s: s.value("n")}, each={"cents": lambda s: s.each("payload")})
    out = transition.render(fold.merge(fold.elided(local, schema).where("false"), local, schema), stream, 0)
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    return out.select("session_key", "row_id", field("cents").cast("bigint").alias("cents"), field("last_priority").alias("last_priority"), field("n_orders").cast("bigint").alias("n_orders"))


@query(
    """WITH st AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
    SELECT s_nationkey::VARCHAR AS session_key, 1 AS sign, '{"n":' || n || ',"sign_flag":1}' AS payload FROM st JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 3)"""
)
def gate_lookup(spark, sf_dir):
    """A stream that is open only where an enrichment table says so."""
    rows = table(spark, sf_dir, "supplier").withColumns({"user": F.col("s_nationkey").cast("string"), "seq": F.col("s_suppkey")})
    schema = Schema("nation", 1, "nationkey", "{user}", {"nation": LastSeen(value=lambda r: r["user"]), "n": Counter()})
    local = fold.fold(ingest.admitted(rows, schema), schema)
    nation = table(spark, sf_dir, "nation")
    dimension = nation.select(F.lit("open").alias("table"), F.col("n_nationkey").cast("string").alias("key"), F.when(F.col("n_regionkey").isin(1, 3), "yes").otherwise("").alias("value"))
    stream = Stream("open", "open", columns={"n": lambda s: s.value("n")}, gate=lambda s: s.lookup("open"), lookups={"open": ("open", lambda s: s.value("nation"))})
    states = fold.merge(fold.elided(local, schema).where("false"), local, schema)
    return transition.render(states, stream, 0, enrichment=dimension).select("session_key", "sign", "payload")


# ------------------------------------------------------------------ raw events, batch by batch


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON texts; every thousandth is cut short."""
    from keyfold.sources.events import as_raw

    rows = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    text = F.to_json(F.struct(F.col("user_id").cast("string").alias("user"), "event_type", F.col("at").alias("nanos"), "event_id"))
    return as_raw(rows, "events", F.when(F.col("event_id") % 1000 == 7, F.substring(text, 1, 20)).otherwise(text), F.col("event_id"))


RAW = Schema("user", 1, "user_id", "{user}", {
    "last": LatestBy(comparator=lambda r: r["nanos"], payload=lambda r: r["event_id"]),
    "by_type": GroupedMap(key=lambda r: r["event_type"], value=LatestBy(comparator=lambda r: r["nanos"], payload=lambda r: r["event_id"])),
    "n": Counter(),
}, ACCEPT)
RAW_STREAMS = Transformer((
    Stream("raw-users", "users", columns={"last": lambda s: s.value("last.payload"), "n": lambda s: s.value("n")}),
    Stream("raw-types", "types", explode="by_type", each={"event": lambda s: s.each("payload")}),
))
WELL = EV + ", ok AS (SELECT * FROM ad WHERE event_id % 1000 <> 7) "


@query("SELECT CASE WHEN event_id % 1000 = 7 THEN 'malformed' WHEN event_type IN ('click', 'view', 'purchase') THEN 'admitted' ELSE 'filtered' END AS tag, count(*) AS n FROM events GROUP BY 1")
def raw_tags(spark, sf_dir):
    """Admitted, filtered and malformed JSON events."""
    return ingest.tag(ingest.parse_records(raw_events(spark, sf_dir)), RAW, "record").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'events:0:' || event_id AS key FROM events WHERE event_id % 1000 = 7")
def dead_letters(spark, sf_dir):
    from keyfold.sources import events as sinks

    tagged = ingest.tag(ingest.parse_records(raw_events(spark, sf_dir)), RAW, "record")
    return sinks.dead_letters(tagged.where(F.col("tag") == ingest.MALFORMED), "dead").select(F.col("key").cast("string").alias("key"))


@query(WELL + "SELECT usr AS session_key, arg_max(event_id, (nanos, event_id)) AS last_event, count(*) AS n FROM ok GROUP BY usr")
def raw_fold(spark, sf_dir):
    """Fold of JSON events through VARIANT paths."""
    rows = ingest.parse_records(raw_events(spark, sf_dir)).withColumn("seq", F.col("offset"))
    local = fold.fold(ingest.admitted(rows, RAW, "record"), RAW, "record")
    return fold.elided(local, RAW).select("session_key", v.as_long(v.Value(F.col("last.payload"), "variant")).alias("last_event"), "n")


@query(
    _LINES.replace("l_returnflag FROM", "l_returnflag, l_quantity::BIGINT AS q FROM")
    + """, a AS (SELECT *, CASE l_linenumber % 4 WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN q + 0.5 END::DOUBLE AS amount,
    CASE l_linenumber % 4 WHEN 1 THEN '"' || q || '"' WHEN 2 THEN q::VARCHAR WHEN 3 THEN q || '.5' END AS shown FROM l)
    SELECT l_orderkey::VARCHAR AS session_key, coalesce(sum(amount), 0)::DOUBLE AS total, count(*) FILTER (l_linenumber % 4 = 3) = 0 AS whole,
    arg_min(shown, (amount, l_linenumber)) FILTER (amount IS NOT NULL) AS least, arg_max(shown, (amount, -l_linenumber)) FILTER (amount IS NOT NULL) AS most,
    count(DISTINCT shown) AS kinds, coalesce(arg_max(l_linenumber, (amount, -l_linenumber)) FILTER (amount IS NOT NULL), 0)::BIGINT AS dearest FROM a GROUP BY l_orderkey"""
)
def reduce_variant(spark, sf_dir):
    """Reducers over raw JSON payloads: numeric texts, integers and fractions in one field."""
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    # a text, an integer or a fraction by the line, and null for some
    amount = F.expr("CASE l_linenumber % 4 WHEN 1 THEN concat('\"', cast(l_quantity AS bigint), '\"') WHEN 2 THEN cast(cast(l_quantity AS bigint) AS string) WHEN 3 THEN concat(cast(l_quantity AS bigint), '.5') ELSE 'null' END")
    text = F.concat(F.lit('{"line":'), F.col("l_linenumber").cast("string"), F.lit(',"amount":'), amount, F.lit("}"))
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "user": F.col("l_orderkey").cast("string"), "line": F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "seq": F.struct("l_linenumber", "l_partkey", "l_suppkey"), "at": at, "raw": F.try_parse_json(text),
    })
    slot = LatestBy(comparator=lambda r: r["at"], payload=lambda r: r["raw"])
    schema = Schema("order", 1, "order_id", "{user}", {"lines": GroupedMap(key=lambda r: r["line"], value=slot)})
    held = fold.elided(fold.fold(ingest.admitted(rows, schema), schema), schema)
    items, field = F.col("items"), c.Measured
    # the amounts are read once, and the sum once: each is a column of its own that the reducers after it share
    rows = held.select("session_key", c.payloads(F.col("lines")).alias("items"))
    rows = rows.select("session_key", c.measured(items, lambda p: v.path(p, "amount")).alias("items"))
    rows = rows.select("session_key", "items", c.total(items, field).col.alias("sum"))
    return rows.select(
        "session_key",
        v.as_double(v.Value(F.col("sum"), "variant")).alias("total"),
        (F.schema_of_variant("sum") == "BIGINT").alias("whole"),
        F.to_json(c.least(items, field)).alias("least"),
        F.to_json(c.greatest(items, field)).alias("most"),
        c.count_distinct(items, field).alias("kinds"),
        F.coalesce(v.as_long(v.path(c.latest_by(items, field)["item"], "line")), F.lit(0)).cast("bigint").alias("dearest"),
    )


#: Bytes of a row group of the streamed files.
ROW_GROUP = 4 << 20


def _scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one; a local one only where driver and executors are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="keyfold-")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, sf_dir: str, **more):
    """A runner that has taken in all events, in three batches of eight files."""
    from keyfold.streaming.runner import Runner

    at = _scratch(spark)
    rows = raw_events(spark, sf_dir)
    # small row groups: as many tasks as there are cores share a large file, not one task a file
    rows.repartitionByRange(24, "offset").write.option("parquet.block.size", str(ROW_GROUP)).parquet(f"{at}/in")
    runner = Runner(spark, RAW, RAW_STREAMS, f"{at}/out", clock=lambda: 0.0, buckets=8, **more)
    runner.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{at}/in")).awaitTermination()
    return runner


@query(WELL + "SELECT usr AS session_key, arg_max(event_id, (nanos, event_id)) AS last_event, count(*) AS n, count(DISTINCT event_type) AS n_types FROM ok GROUP BY usr")
def streaming_state(spark, sf_dir):
    """The state after a Structured Streaming run over batches of files of events: the same as one fold of all."""
    held = _streamed(spark, sf_dir, compact_every=2).state.current()
    return held.select("session_key", v.as_long(v.Value(F.col("last.payload"), "variant")).alias("last_event"), "n", F.size("by_type").cast("bigint").alias("n_types"))


@query(WELL + "SELECT usr AS session_key, event_type AS row_id, 1::BIGINT AS net, max(event_id) AS event FROM ok GROUP BY ALL")
def streaming_deltas(spark, sf_dir):
    """Signed deltas of the same run add up to one row for each entry."""
    runner = _streamed(spark, sf_dir)
    found = spark.read.parquet(f"{runner.path}/deltas").where("stream = 'raw-types'")
    event = F.get_json_object("payload", "$.event").cast("bigint")
    return found.groupBy("session_key", "row_id").agg(F.sum("sign").cast("bigint").alias("net"), F.sum(F.col("sign") * event).cast("bigint").alias("event"))
