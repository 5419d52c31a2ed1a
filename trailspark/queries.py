"""Registered queries: one for each operator, predicate, function group and aggregate, with equal SQL.

Every query runs over its whole tables. Where a result depends on chance or on
unordered input there is no SQL.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.engine import Engine
from trailspark.operators.relation import Relation
from trailspark.sources.catalog import Catalog, typed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: String columns that hold JSON.
DYNAMIC = {"events": {"props"}}
#: The clock of now() and ago().
NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)


class _Folder(Catalog):
    """Parquet tables of a folder, each opened when a query first names it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def find(self, name: str) -> Relation | None:
        key = name.lower()
        if key in TABLES and super().find(key) is None:
            self.add(key, typed(self.spark.read.parquet(f"{self.sf_dir}/{key}.parquet"), DYNAMIC.get(key)))
        return super().find(key)

    def names(self) -> list[str]:
        return sorted(TABLES)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, _Folder(spark, sf_dir), NOW)


#: name -> (query, SQL or None)
KQL: dict[str, tuple[str, str | None]] = {
    "where": ('lineitem | where l_quantity >= 45 and l_returnflag in ("A", "R") | project l_orderkey, l_linenumber, l_quantity', "select l_orderkey, l_linenumber::bigint l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_returnflag in ('A', 'R')"),
    "filter": ("orders | filter o_totalprice < 20000 or o_orderstatus == 'P' | project o_orderkey, o_orderstatus", "select o_orderkey, o_orderstatus from orders where o_totalprice < 20000 or o_orderstatus = 'P'"),
    "project": ("orders | project key=o_orderkey, half=o_totalprice / 2, o_orderpriority", "select o_orderkey as key, o_totalprice / 2 as half, o_orderpriority from orders"),
    "project_away": ("customer | project-away c_name, c_acctbal", "select c_custkey, c_nationkey::bigint c_nationkey, c_mktsegment from customer"),
    "project_keep": ("customer | project-keep c_mktsegment, c_custkey", "select c_custkey, c_mktsegment from customer"),
    "project_rename": ("nation | project-rename key=n_nationkey, region=n_regionkey", 'select n_nationkey::bigint as key, n_name, n_regionkey::bigint as region from nation'),
    "project_reorder": ("supplier | project-reorder s_acctbal, s_suppkey", "select s_acctbal, s_suppkey, s_name, s_nationkey::bigint s_nationkey from supplier"),
    "extend": ("part | extend p_size=p_size + 1, double_price=p_retailprice * 2 | project p_partkey, p_size, double_price", "select p_partkey, p_size::bigint + 1 as p_size, p_retailprice * 2 as double_price from part"),
    "summarize": (
        "lineitem | summarize n=count(), big=countif(l_quantity > 25), qty=sum(l_quantity), late=sumif(l_quantity, l_linestatus == 'O'), lo=min(l_discount), hi=max(l_tax), first=take_any(l_shipdate) by l_returnflag, l_linestatus",
        "select l_returnflag, l_linestatus, count(*) n, count(*) filter (l_quantity > 25) big, sum(l_quantity) qty, sum(case when l_linestatus = 'O' then l_quantity end) late, min(l_discount) lo, max(l_tax) hi, min(l_shipdate) as first from lineitem group by all",
    ),
    "summarize_global": ("orders | summarize n=count(), mean=avg(o_custkey), top=max(o_orderdate)", "select count(*) n, avg(o_custkey) mean, max(o_orderdate) as top from orders"),
    "summarize_expression": ("orders | summarize spread=max(o_custkey) - min(o_custkey), n=count() by decade=o_custkey / 100", "select o_custkey // 100 as decade, max(o_custkey) - min(o_custkey) as spread, count(*) n from orders group by 1"),
    "distinct": ("customer | distinct c_mktsegment, c_nationkey", "select distinct c_mktsegment, c_nationkey::bigint c_nationkey from customer"),
    "count": ("lineitem | where l_tax > 0.05 | count", 'select count(*) as "Count" from lineitem where l_tax > 0.05'),
    "serialize": ("region | serialize | project r_regionkey, r_name", "select r_regionkey::bigint r_regionkey, r_name from region"),
    "order_by": ("orders | order by o_totalprice desc, o_orderkey asc | project o_orderkey, o_totalprice", "select o_orderkey, o_totalprice from orders"),
    "sort_by": ("part | sort by p_partkey asc | project p_partkey, p_brand", "select p_partkey, p_brand from part"),
    "top": ("let n = 10; orders | top n by o_totalprice desc, o_orderkey asc | project o_orderkey, o_totalprice", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10"),
    "take": ("orders | order by o_orderkey asc | take 25 | project o_orderkey", "select o_orderkey from orders order by o_orderkey limit 25"),
    "limit": ("customer | order by c_custkey asc | limit 7 | project c_custkey", "select c_custkey from customer order by c_custkey limit 7"),
    # what is drawn is chance; that it is as many different rows of the table as asked for is not
    "sample": ("let s = orders | sample 20 | project o_orderkey; s | join kind=inner (orders | project o_orderkey, o_custkey) on o_orderkey | where o_custkey > 0 | distinct o_orderkey | count", 'select least(20, count(distinct o_orderkey))::bigint as "Count" from orders where o_custkey > 0'),
    "sample_distinct": ("let s = customer | sample-distinct 3 of c_mktsegment; s | join kind=leftsemi (customer) on c_mktsegment | distinct c_mktsegment | count", 'select least(3, count(distinct c_mktsegment))::bigint as "Count" from customer'),
    "as_self_join": ("nation | as n | join kind=inner (n | project n_regionkey, peer=n_name) on n_regionkey | project n_name, peer", "select a.n_name, b.n_name as peer from nation a join nation b on a.n_regionkey = b.n_regionkey"),
    "let": ('let floor = 400000; let big = orders | where o_totalprice > floor; big | summarize n=count() by o_orderstatus', "select o_orderstatus, count(*) n from orders where o_totalprice > 400000 group by 1"),
    "union": ("customer | project key=c_custkey, name=c_name | union (supplier | project s_suppkey, s_name)", "select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier"),
    "join_inner": ("orders | project o_orderkey, o_custkey | join kind=inner (customer | project c_custkey, c_name) on $left.o_custkey == $right.c_custkey", "select o_orderkey, o_custkey, c_custkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_leftouter": ("customer | project k=c_custkey | join kind=leftouter (orders | where o_totalprice > 400000 | project k=o_custkey, o_orderkey) on k", "select c_custkey as k, o_custkey as k1, o_orderkey from customer left join (select * from orders where o_totalprice > 400000) on c_custkey = o_custkey"),
    "join_rightouter": ("orders | where o_totalprice > 400000 | project k=o_custkey, o_orderkey | join kind=rightouter (customer | project k=c_custkey) on k", "select o_custkey as k, o_orderkey, c_custkey as k1 from (select * from orders where o_totalprice > 400000) right join customer on c_custkey = o_custkey"),
    "join_fullouter": (
        "customer | where c_acctbal > 0 | project k=c_custkey | join kind=fullouter (orders | where o_totalprice > 300000 | project k=o_custkey, o_orderkey) on k",
        "select a.k, b.k as k1, o_orderkey from (select c_custkey as k from customer where c_acctbal > 0) a full join (select o_custkey as k, o_orderkey from orders where o_totalprice > 300000) b on a.k = b.k",
    ),
    "join_leftsemi": ("customer | project c_custkey | join kind=leftsemi (orders | where o_totalprice > 400000) on $left.c_custkey == $right.o_custkey", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)"),
    "join_leftanti": ("customer | project c_custkey | join kind=leftanti (orders | where o_totalprice > 250000) on $left.c_custkey == $right.o_custkey", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)"),
    "lookup": ("customer | project c_custkey, n_nationkey=c_nationkey | lookup kind=leftouter (nation | project n_nationkey, n_name) on n_nationkey", "select c_custkey, c_nationkey::bigint as n_nationkey, n_name from customer left join nation on c_nationkey = nation.n_nationkey"),
    "lookup_inner": ("nation | lookup kind=inner (region | where r_name startswith 'a') on $left.n_regionkey == $right.r_regionkey | project n_name, r_name", "select n_name, r_name from nation join region on n_regionkey = r_regionkey where lower(r_name) like 'a%'"),
    "search": ('documents | search "license" | project doc_id', "select doc_id from documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9])license([^A-Za-z0-9]|$)') or regexp_matches(source, '(?i)(^|[^A-Za-z0-9])license([^A-Za-z0-9]|$)') or regexp_matches(lang, '(?i)(^|[^A-Za-z0-9])license([^A-Za-z0-9]|$)')"),
    "has": (
        'documents | project doc_id, a=text has "The", b=text has_cs "The", c=text hasprefix "lic", d=text hassuffix "tion", e=text !has "that", f=text has_any ("idiot", "moron"), g=text has_all ("the", "of")',
        r"""select doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') a, regexp_matches(text, '(^|[^A-Za-z0-9])The([^A-Za-z0-9]|$)') b, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])lic') c, regexp_matches(text, '(?i)tion([^A-Za-z0-9]|$)') d,
        not regexp_matches(text, '(?i)(^|[^A-Za-z0-9])that([^A-Za-z0-9]|$)') e, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(idiot|moron)([^A-Za-z0-9]|$)') f, regexp_matches(text, '(?i)(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') and regexp_matches(text, '(?i)(^|[^A-Za-z0-9])of([^A-Za-z0-9]|$)') g from documents""",
    ),
    "contains": (
        'part | project p_partkey, a=p_name contains "AR", b=p_type contains_cs "EEL", c=p_brand startswith "brand#1", d=p_brand startswith_cs "brand", e=p_type endswith "el", f=p_name !contains "1", g=p_brand !startswith "b"',
        "select p_partkey, contains(lower(p_name), 'ar') a, contains(p_type, 'EEL') b, starts_with(lower(p_brand), 'brand#1') c, starts_with(p_brand, 'brand') d, ends_with(lower(p_type), 'el') e, not contains(lower(p_name), '1') f, not starts_with(lower(p_brand), 'b') g from part",
    ),
    "equality": ('customer | project c_custkey, a=c_mktsegment =~ "Building", b=c_mktsegment !~ "building", c=c_mktsegment == "building", d=c_nationkey != 3', "select c_custkey, lower(c_mktsegment) = 'building' a, lower(c_mktsegment) <> 'building' b, c_mktsegment = 'building' c, c_nationkey <> 3 d from customer"),
    "membership": ('customer | project c_custkey, a=c_mktsegment in ("BUILDING"), b=c_mktsegment !in ("BUILDING"), c=c_mktsegment in~ ("building", "Machinery"), d=c_mktsegment !in~ ("building"), e=c_nationkey in (1, 2, 3)', "select c_custkey, c_mktsegment in ('BUILDING') a, c_mktsegment not in ('BUILDING') b, lower(c_mktsegment) in ('building', 'machinery') c, lower(c_mktsegment) not in ('building') d, c_nationkey in (1, 2, 3) e from customer"),
    "between": ("part | project p_partkey, a=p_size between (10 .. 20), b=p_retailprice !between (1000 .. 1500)", "select p_partkey, p_size between 10 and 20 a, p_retailprice not between 1000 and 1500 b from part"),
    "logic": ("orders | where not(o_orderstatus == 'F') and (o_custkey % 2 == 0 or o_totalprice > 300000) | project o_orderkey", "select o_orderkey from orders where not (o_orderstatus = 'F') and (o_custkey % 2 = 0 or o_totalprice > 300000)"),
    "arithmetic": ("orders | project o_orderkey, a=o_custkey + 1, b=o_custkey - 1000, c=o_custkey * 3, d=o_custkey / 7, e=o_custkey % 7, f=-o_custkey, g=o_totalprice / 4, h=o_custkey / 0, i=1.0 * o_custkey", "select o_orderkey, o_custkey + 1 a, o_custkey - 1000 b, o_custkey * 3 c, o_custkey // 7 d, o_custkey % 7 e, -o_custkey f, o_totalprice / 4 g, null::bigint h, 1.0::double * o_custkey i from orders"),
    "dynamic_path": ("events | project event_id, k=tolong(props.k), missing=isnull(props.none), t=tostring(props['k']), big=props.k > 50", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) * case when json_extract_string(props, '$.k') is null then null else 1 end k, true missing, json_extract_string(props, '$.k') t, try_cast(json_extract_string(props, '$.k') as double) > 50 big from events"),
    "json_functions": ("events | project event_id, n=array_length(props), keys=tostring(bag_keys(props)), has=bag_has_key(props, 'k'), no=bag_has_key(props, '$.k.x')", "select event_id, null::bigint n, '[\"' || array_to_string(list_sort(json_keys(props)), '\",\"') || '\"]' as keys, list_contains(json_keys(props), 'k') has, false as no from events"),
    "parse_json": ("part | extend j=parse_json(strcat('{\"a\":[', tostring(p_size), ',2],\"b\":{\"c\":', tostring(p_partkey), '}}')) | project p_partkey, first=tolong(j.a[0]), n=array_length(j.a), c=tolong(j.b.c), inside=set_has_element(j.a, 2.0), one=set_has_element(j.a, p_size)", "select p_partkey, p_size::bigint as first, 2::bigint n, p_partkey c, true inside, true as one from part"),
    "mv_expand": ("customer | mv-expand with_itemindex=i word=split(c_mktsegment, 'I') to typeof(string) | project c_custkey, i, word", "select c_custkey, unnest(range(len(w)))::bigint as i, unnest(w) as word from (select c_custkey, string_split(c_mktsegment, 'I') w from customer)"),
    "mv_expand_limit": ("embeddings | mv-expand with_itemindex=i x=embedding limit 3 | project vec_id, i, up=todouble(x) > 0.0, far=todouble(x) > 0.05", "select vec_id, i, x > 0 as up, x > 0.05 as far from (select vec_id, unnest(range(3))::bigint as i, unnest(embedding[1:3])::double as x from embeddings)"),
    "mv_apply": ("embeddings | mv-apply x=embedding on (where x > 0.0 | extend big=x > 0.1) | summarize n=count(), b=countif(big) by vec_id", "select vec_id, count(*) n, count(*) filter (x > 0.1) b from (select vec_id, unnest(embedding)::double x from embeddings) where x > 0 group by 1"),
    "datetime": ('events | where ts >= datetime("2024-01-05T00:00:00Z") and ts < datetime("2024-01-20") | project event_id, ts', "select event_id, ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'"),
    "now_ago": ("events | where ts > ago(150d) and ts <= now() | project event_id, w=ts + 1h", "select event_id, ts + interval 1 hour as w from events where ts > timestamp '2024-06-01' - interval 150 day and ts <= timestamp '2024-06-01'"),
    "todatetime": ("orders | project o_orderkey, a=todatetime(strcat('2024-01-', iff(o_orderkey % 20 < 10, '0', ''), tostring(o_orderkey % 20), 'T03:04:05.25+02:00')), b=todatetime('nope')", "select o_orderkey, try_cast('2024-01-' || lpad((o_orderkey % 20)::varchar, 2, '0') || ' 03:04:05.25' as timestamp) - interval 2 hour as a, null::timestamp as b from orders"),
    "casts": ("part | project p_partkey, a=toint(p_brand), b=tolong(substring(p_brand, 6)), c=toreal(p_retailprice), d=todouble('2.5x'), e=tostring(p_size), f=tolong(p_retailprice), g=toint('12abc')", "select p_partkey, 0::bigint a, substr(p_brand, 7)::bigint b, p_retailprice c, 2.5::double d, p_size::varchar e, trunc(p_retailprice)::bigint f, 12::bigint g from part"),
    "null_checks": ("documents | project doc_id, a=isnull(text), b=isnotnull(lang), c=isempty(''), d=isnotempty(source), e=coalesce(lang, 'none')", "select doc_id, text is null a, lang is not null b, true c, (source is not null and source <> '') d, coalesce(lang, 'none') e from documents"),
    "conditionals": ("part | project p_partkey, a=iff(p_size > 25, 'big', 'small'), b=case(p_size < 10, 1, p_size < 20, 2, 3)", "select p_partkey, if(p_size > 25, 'big', 'small') a, case when p_size < 10 then 1 when p_size < 20 then 2 else 3 end::bigint b from part"),
    "text_functions": (
        "part | project p_partkey, a=strlen(p_name), b=substring(p_type, 1, 3), c=strcat(p_brand, '-', p_size), d=tolower(p_type), e=toupper(p_name), f=replace_string(p_type, 'E', 'ee'), g=trim('[A-D]', p_type), h=extract('#(\\\\d)(\\\\d)', 2, p_brand), i=extract('x(y)', 5, p_name), j=tostring(split(p_brand, '#'))",
        r"""select p_partkey, length(p_name) a, substr(p_type, 2, 3) b, p_brand || '-' || p_size c, lower(p_type) d, upper(p_name) e, replace(p_type, 'E', 'ee') f, regexp_replace(regexp_replace(p_type, '^[A-D]+', ''), '[A-D]+$', '') g, regexp_extract(p_brand, '#(\d)(\d)', 2) h, '' i, '["' || array_to_string(string_split(p_brand, '#'), '","') || '"]' j from part""",
    ),
    "decode": ("part | project p_partkey, a=url_decode(strcat('https%3A%2F%2Fx.org%2F', p_partkey, '+%20')), b=base64_decode_tostring('aGVsbG8='), c=url_decode('%FF'), d=base64_decode_tostring('aGVsbG8')", "select p_partkey, 'https://x.org/' || p_partkey || '+ ' a, 'hello' b, null::varchar c, null::varchar d from part"),
    "ipv4": (
        "orders | extend ip=strcat(o_custkey % 256, '.', o_orderkey % 256, '.1.', o_custkey % 300) | project o_orderkey, p=ipv4_is_private(ip), r=ipv4_is_in_range(ip, '10.0.0.0/8, 192.168.0.0/16,172.16.1.9/12'), bad=ipv4_is_in_range(ip, '10.0.0.0/33')",
        """select o_orderkey, case when d < 256 then a = 10 or (a = 192 and b = 168) or (a = 172 and b between 16 and 31) end p, case when d < 256 then a = 10 or (a = 192 and b = 168) or (a = 172 and b between 16 and 31) end r, null::boolean bad
        from (select o_orderkey, o_custkey % 256 a, o_orderkey % 256 b, o_custkey % 300 d from orders)""",
    ),
    "make_set": ("events | summarize types=make_set(event_type), n=count() by user_id", "select user_id, '[' || string_agg(distinct '\"' || event_type || '\"', ',' order by '\"' || event_type || '\"') || ']' types, count(*) n from events group by 1"),
    "make_list": (
        "orders | summarize l=make_list(o_orderkey), m=count() by o_custkey | where m <= 1000 | mv-expand x=l to typeof(long) | summarize n=count(), total=sum(x), least=min(x), most=max(x) by o_custkey",
        "select o_custkey, count(*) n, sum(o_orderkey)::bigint total, min(o_orderkey) least, max(o_orderkey) most from orders group by 1 having count(*) <= 1000",
    ),
    "top_customers": (
        "orders | join kind=inner (customer) on $left.o_custkey == $right.c_custkey | join kind=inner (nation) on $left.c_nationkey == $right.n_nationkey | summarize n=count(), biggest=max(o_totalprice) by n_name, c_mktsegment | order by n desc",
        "select n_name, c_mktsegment, count(*) n, max(o_totalprice) biggest from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    ),
}


def _kql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).compile(text).df


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors see; a local one where the cluster names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='trailspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/import-{uuid.uuid4().hex}"


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of a partition as an array: the first and last carry the brackets."""
    held = None
    for b in batches:
        lines = []
        for value in b.column(0).to_pylist():
            lines += ["[" + value] if held is None else [held + ",", value]
            held = lines.pop()
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held + "]"])], names=["value"])


def _imported(format_: str, query: str, tables: tuple[str, ...] = ("Log",)) -> Callable[[SparkSession, str], DataFrame]:
    """The events table written as files, imported and queried."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from trailspark.sources.ingest import Workspace
        from trailspark.sources.manifest import DatasetConfig, Manifest

        folder = _scratch(spark)
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        flat = events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.concat(F.lit("src-"), F.col("user_id") % 3).alias("origin"), "event_id", "user_id", "event_type", "value", "props")
        datasets = []
        for n, table in enumerate(tables):
            part = flat.where(F.col("event_id") % len(tables) == n) if len(tables) > 1 else flat
            path = f"{folder}/in-{n}"
            if format_ == "csv":
                part.write.csv(path, header=True, quoteAll=True, escape='"')
            elif format_ == "array":
                # one array of one line a file
                part.select("event_id", F.to_json(F.struct(*part.columns)).alias("value")).repartition(8, "event_id").select("value").mapInArrow(_bracketed, "value string").write.text(path, lineSep=" ")
            elif format_ == "escaped":
                # the first letter of the type is written as an escape
                part.select(F.concat(F.lit('{"ts":"'), "ts", F.lit('","origin":"'), "origin", F.lit('","event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"\\u'), F.lpad(F.hex(F.ascii("event_type")), 4, "0"), F.expr("substr(event_type, 2)"), F.lit('"}')).alias("value")).write.text(path)
            else:
                part.select(F.to_json(F.struct(*part.columns)).alias("value")).write.text(path, compression="gzip" if format_ == "gzip" else "none")
            datasets.append(DatasetConfig(f"d{n}", table, path, "csv" if format_ == "csv" else "json", "", "origin", "ts"))
        workspace = Workspace(spark, f"{folder}/workspace")
        workspace.load(Manifest(datasets=tuple(datasets)))
        return Engine(spark, workspace.catalog(), NOW).compile(query).df

    return run


_LOG = "Log | where props.k >= 50 | summarize n=count(), lo=min(TimeGenerated), hi=max(TimeGenerated), sources=tostring(make_set(Source)) by event_type"
_LOG_SQL = "select event_type, count(*) n, min(ts) lo, max(ts) hi, '[\"' || string_agg(distinct 'src-' || user_id % 3, '\",\"' order by 'src-' || user_id % 3) || '\"]' sources from events where try_cast(json_extract_string(props, '$.k') as double) >= 50 group by 1"
_TIMES_SQL = "select event_id as id, 's' || event_id % 4 as \"Source\", case event_id % 4 when 0 then ts when 2 then date_trunc('millisecond', ts) else date_trunc('second', ts) end as \"TimeGenerated\" from events"
IMPORTED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "import_ndjson": (_imported("json", _LOG), _LOG_SQL),
    "import_gzip": (_imported("gzip", _LOG), _LOG_SQL),
    "import_csv": (_imported("csv", _LOG), _LOG_SQL),
    "import_json_array": (_imported("array", _LOG), _LOG_SQL),
    "events_union": (_imported("json", "Events | project id=tolong(event_id), Source, event_type", ("Left", "Right")), "select event_id as id, 'src-' || user_id % 3 as \"Source\", event_type from events"),
    "events_search_escaped": (_imported("escaped", 'Log | search "purchase" | project id=tolong(event_id), TimeGenerated'), 'select event_id as id, ts as "TimeGenerated" from events where event_type = \'purchase\''),
    "events_search": (_imported("json", 'Events | search "purchase" | project id=tolong(event_id), TimeGenerated', ("Left", "Right")), 'select event_id as id, ts as "TimeGenerated" from events where event_type = \'purchase\''),
}


#: Timestamp format -> expression that writes an event's time so.
TIME_FORMATS = {
    "rfc3339": "date_format(ts + interval 2 hours, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'\")",
    "unix": "cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) / 1000000) as bigint)",
    "unix_ms": "cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) / 1000) as bigint)",
    "Jan 2, 2006 at 15:04:05 -0700": "date_format(ts, \"MMM d, yyyy 'at' HH:mm:ss '+0000'\")",
}


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the events in each timestamp format."""
    from trailspark.sources.ingest import Workspace
    from trailspark.sources.manifest import DatasetConfig, Manifest

    folder, datasets = _scratch(spark), []
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for n, (name, column) in enumerate(TIME_FORMATS.items()):
        events.where(F.col("event_id") % 4 == n).select(F.to_json(F.struct(F.expr(column).alias("at"), "event_id")).alias("value")).write.text(f"{folder}/in-{n}")
        datasets.append(DatasetConfig(f"d{n}", f"T{n}", f"{folder}/in-{n}", "json", f"s{n}", "", "at", name))
    workspace = Workspace(spark, f"{folder}/workspace")
    workspace.load(Manifest(datasets=tuple(datasets)))
    return Engine(spark, workspace.catalog(), NOW).compile("Events | project id=tolong(event_id), Source, TimeGenerated").df


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailspark.operators.timeline import histogram

    return histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _kql(text) for name, (text, _) in KQL.items()} | {name: run for name, (run, _) in IMPORTED.items()} | {"import_time_formats": _times, "timeline_histogram": _histogram}

ORACLES: dict[str, str] = {name: sql for name, (_, sql) in KQL.items() if sql} | {name: sql for name, (_, sql) in IMPORTED.items()} | {
    "import_time_formats": _TIMES_SQL,
    "timeline_histogram": """with r as (select min(ts) lo, max(ts) hi, least(24, ceil(sqrt(count(*))))::bigint k from events),
    b as (select least(floor((epoch_us(ts) - epoch_us(lo)) / (greatest(epoch_us(hi) - epoch_us(lo), 1)::double / k)), k - 1)::bigint bucket from events, r)
    select bucket, count(*) n from b group by 1"""
}

FLAGSHIP = "orders | where o_totalprice > 100000 | summarize c=count(), total=sum(o_totalprice) by o_orderstatus | order by c desc"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).compile(FLAGSHIP).df
