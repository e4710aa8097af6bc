"""The registered queries of dialogue preparation, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions import values as V
from dialoom.operators import order, pairing, refs, resolve, stats
from dialoom.sources import readers, sinks

from .fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Prefixes and classes of image references, the system prompt of chat rows.
CLASSES = {"alpha/": "alpha", "beta/": "beta", "images/": "beta", "gamma/": "gamma"}
SYSTEM = "You are a helpful assistant."
PREFIX = "beta/"


def _add(name: str, sql: str, *tables: str):
    """Register a function of DataFrames as a query over the named tables."""

    def deco(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables))
        SQL[name] = with_views(sql)
        return f

    return deco


def _scalar(name: str, spark_columns: Callable[[], dict[str, Column]], sql_columns: str, table: str, key: str, base: str = "") -> None:
    """A query that adds scalar columns to the keys of a table."""

    def run(df: DataFrame) -> DataFrame:
        return df.select(*key.split(", "), *(c.alias(k) for k, c in spark_columns().items()))

    _add(name, f"select {key}, {sql_columns} from {base or table}", table)(run)


WS = f"'{T.WHITESPACE}'"
IMG = "(image is not null and image <> '')"
SEG = "split_part({0},'/',1)"
AFTER = "case when strpos({0},'{1}')>0 then substr({0},strpos({0},'{1}')+" + "{2}) end"


def _after(x: str, m: str) -> str:
    return AFTER.format(x, m, len(m))


_SCORE_TEXT = f"rtrim(trim(split_part({_after('value', 'Score:')},chr(10),1),{WS}),'.')"


def _number(x: str) -> str:
    return (
        f"case when regexp_matches({x},'{T.INTEGER}') then cast(try_cast({x} as decimal(38,0)) as varchar) "
        f"when regexp_matches({x},'{T.DECIMAL}') then cast(try_cast({x} as double) as varchar) end"
    )


ANSWER_SQL = f"coalesce(trim(coalesce({_after('value', 'Answer:')}, value),{WS}),'')"
FEEDBACK_SQL = (
    f"case when coalesce(value,'')='' then '' when coalesce(trim({_after('value', 'Feedback:')},{WS}),'')='' then trim(value,{WS}) "
    f"else coalesce('A score of '||({_number(_SCORE_TEXT)})||' is given to the answer. '||trim({_after('value', 'Feedback:')},{WS}), trim({_after('value', 'Feedback:')},{WS})) end"
)
CLASS_SQL = "case when starts_with(image,'alpha/') then 'alpha' when starts_with(image,'beta/') or starts_with(image,'images/') then 'beta' when starts_with(image,'gamma/') then 'gamma' else 'unknown' end"
ROUNDS_SQL = f"""a as (select conv_id, turn, role, kind, {ANSWER_SQL} as answer, lead(role) over w as nrole, lead(kind) over w as nkind, lead(value) over w as nvalue from refl_turns window w as (partition by conv_id order by turn)),
 r as (select conv_id, turn, answer, case when nrole='teacher' and nkind='feedback' then ({FEEDBACK_SQL.replace('value', 'nvalue')}) end as feedback from a where role='student' and kind='response' and answer<>'')"""
NUMBERED_SQL = ROUNDS_SQL + ", n as (select *, row_number() over w - 1 as round, lag(feedback) over w as before from r window w as (partition by conv_id order by turn))"
QUESTION_SQL = "q as (select conv_id, trim(arg_min(text, turn)," + WS + ") as question from conversations where role='user' group by 1)"
EXCHANGE_SQL = f"with {NUMBERED_SQL}, {QUESTION_SQL}, e as (select conv_id, round, case when round=0 then question else before end as human, answer as assistant from n join q using(conv_id) where question<>''), x as (select * from e where coalesce(human,'')<>'')"
PAIRS_SQL = "p as (select conv_id, turn, text as human, lead(text) over w as assistant, role, lead(role) over w as nrole from conversations window w as (partition by conv_id order by turn)), x as (select conv_id, turn, human, assistant from p where role in ('human','user') and nrole in ('gpt','assistant') and human<>'' and assistant<>'')"
PATHS = "select distinct image as path from image_refs where " + IMG
PJOIN_SQL = f"k as ({PATHS}), pj as (select k.path, c.* from k join catalog c on split_part(path,'/',1)=c.source and split_part(path,'/',2)=c.subfolder where len(split(path,'/'))>=3)"
ID_SQL = "regexp_replace(split_part({0},'/',-1),'\\.[^.]*$','')"
NEEDED = "select doc_id, text from documents where doc_id % 3 = 0"


def _paths(df: DataFrame) -> DataFrame:
    return df.where(refs.has_image(F.col("image"))).select(F.col("image").alias("path")).distinct()


def _questions(conversations: DataFrame) -> DataFrame:
    first = conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    return first.select("conv_id", T.strip(F.col("q")).alias("question"))


IMAGE_SQL = "case when conv_id%7<>3 then 'images/train/train_'||printf('%06d',conv_id)||'.jpg' else '' end"


def conversation_images(conversations: DataFrame) -> DataFrame:
    """(conv_id, image): a placeholder path for all dialogues but one in seven."""
    path = F.concat(F.lit("images/train/train_"), T.zero_pad(F.col("conv_id"), 6), F.lit(".jpg"))
    return conversations.where("conv_id % 7 <> 3").select("conv_id", path.alias("image")).distinct()


# --- scans -------------------------------------------------------------------------------

def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = [lambda n=n: view(spark, sf_dir, n) for n in ("no_such_table", "region")]
    return readers.first_available(tries).select("r_regionkey", "r_name")


QUERIES["source_fallback"], SQL["source_fallback"] = _fallback, "select r_regionkey, r_name from region"
_add("scan_union_splits", "select 'train' as split, 0 as split_ord, doc_id from documents where doc_id%10<>0 union all select 'test',1,doc_id from documents where doc_id%10=0", "documents")(
    lambda d: readers.union_splits([("train", d.where("doc_id % 10 <> 0")), ("test", d.where("doc_id % 10 = 0"))]).select("split", "split_ord", "doc_id")
)
_add("image_exists_semi", f"with k as ({PATHS}), f as (select distinct image as path from image_refs where ref_id%2=0) select path from k where path in (select path from f where path is not null)", "image_refs")(
    lambda r: _paths(r).join(r.where("ref_id % 2 = 0").select(F.col("image").alias("path")), "path", "left_semi")
)
_add("image_missing_anti", f"with k as ({PATHS}) select path from k where path not in (select image from image_refs where ref_id%2=0 and image is not null)", "image_refs")(
    lambda r: _paths(r).join(r.where("ref_id % 2 = 0").select(F.col("image").alias("path")), "path", "left_anti")
)
_KIND_SQL = "case when {0} is null then 'missing' when {0}='' then 'empty' when starts_with({0},'data:image') then 'data_uri' when starts_with({0},'http://') or starts_with({0},'https://') then 'url' when contains({0},'/') or regexp_matches({0},'\\.[A-Za-z0-9]{{1,5}}$') then 'path' else 'base64' end"
def _payload() -> Column:
    return F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("data:image/png;base64,"), F.col("split"))).otherwise(F.col("image"))
_scalar("image_payload_kind", lambda: {"kind": V.payload_kind(_payload())}, _KIND_SQL.format("p") + " as kind", "image_refs", "ref_id", "(select *, case when ref_id%3=0 then 'data:image/png;base64,'||split else image end as p from image_refs) t")

# --- projections and filters -------------------------------------------------------------

_add("filter_has_image", f"select ref_id, image from image_refs where {IMG}", "image_refs")(lambda r: r.where(refs.has_image(F.col("image"))).select("ref_id", "image"))
_add("filter_has_image_strict", "select ref_id, image from image_refs where image is not null", "image_refs")(lambda r: r.where(refs.has_image_strict(F.col("image"))).select("ref_id", "image"))
_add("filter_source", "select ref_id, image from image_refs where split_part(image,'/',1) in ('alpha','beta')", "image_refs")(
    lambda r: r.where(refs.in_sources(F.col("image"), ["alpha", "beta"])).select("ref_id", "image")
)
_add("classify_source", f"select class, count(distinct image) as n from (select image, {CLASS_SQL} as class from image_refs where {IMG}) t where class<>'unknown' group by 1", "image_refs")(
    lambda r: _paths(r).withColumn("class", refs.source_class(F.col("path"), CLASSES)).where("class <> 'unknown'").groupBy("class").agg(F.count("*").alias("n"))
)
_add("count_by_class", f"select {CLASS_SQL} as class, count(distinct image) as n from image_refs where {IMG} group by 1", "image_refs")(
    lambda r: _paths(r).groupBy(refs.source_class(F.col("path"), CLASSES).alias("class")).agg(F.count("*").alias("n"))
)
_add("filter_role_alias", "select conv_id, turn from conversations where role in ('human','user')", "conversations")(lambda c: c.where(F.col("role").isin(*pairing.HUMAN)).select("conv_id", "turn"))
_scalar("add_system_prompt", lambda: {"system": F.lit(SYSTEM)}, f"'{SYSTEM}' as system", "conversations", "conv_id, turn")
_IDX = "row_number() over (partition by split order by ref_id) - 1"
_add("sample_id", f"select ref_id, split||'_'||printf('%06d',{_IDX}) as sample_id from image_refs", "image_refs")(
    lambda r: order.with_position(r, "ref_id", "idx", ["split"]).select("ref_id", F.concat("split", F.lit("_"), T.zero_pad(F.col("idx"), 6)).alias("sample_id"))
)
_add("placeholder_path", f"select ref_id, 'images/'||split||'/'||split||'_'||printf('%06d',{_IDX})||'.jpg' as path from image_refs", "image_refs")(
    lambda r: order.with_position(r, "ref_id", "idx", ["split"]).select("ref_id", F.concat(F.lit("images/"), "split", F.lit("/"), "split", F.lit("_"), T.zero_pad(F.col("idx"), 6), F.lit(".jpg")).alias("path"))
)
_scalar("id_or_index", lambda: {"id": F.coalesce(F.col("raw_id").cast("string"), F.col("row_idx").cast("string"))}, "coalesce(cast(raw_id as varchar),cast(row_idx as varchar)) as id", "source_rows", "dataset, split, row_idx")
_scalar("image_id_from_path", lambda: {"id": refs.image_id(F.col("image")), "number": refs.whole_id(F.col("image"))}, f"{ID_SQL.format('image')} as id, case when regexp_matches({ID_SQL.format('image')},'^[+-]?[0-9]+$') then try_cast({ID_SQL.format('image')} as bigint) end as number", "image_refs", "ref_id")
_scalar("path_from_id", lambda: {"path": refs.path_from_id(F.col("ref_id"), F.col("split"))}, "'coco/'||split||'2017/'||printf('%012d',ref_id)||'.jpg' as path", "image_refs", "ref_id")
_scalar("target_path", lambda: {"ext": refs.extension_for(F.col("image"))}, "case when image like '%.jpg' or image like '%.jpeg' then '.jpg' else '.png' end as ext", "image_refs", "ref_id")
# --- joins -------------------------------------------------------------------------------

_add("needed_semi", "select doc_id, source from documents where doc_id in (select doc_id from labels)", "documents", "labels")(lambda d, n: d.select("doc_id", "source").join(n, "doc_id", "left_semi"))
_FILES_SQL = "f as (select distinct split_part(image,'/',-1) as filename from image_refs where " + IMG + ")"
_add(
    "ext_priority_join",
    f"with i as (select distinct cast(doc_id as varchar) as id from labels), c as (select id, p, id||e as filename from i, (values (0,'.jpg'),(1,'.png'),(2,'.jpeg'),(3,'')) t(p,e)), {_FILES_SQL} select id, arg_min(filename,p) as filename from c join f using(filename) group by 1",
    "labels", "image_refs",
)(lambda n, r: resolve.first_extension(n.select(F.col("doc_id").cast("string").alias("id")), _paths(r).select(T.last_segment(F.col("path")).alias("filename"))))
_add(
    "lookup_with_fallback",
    f"with f as (select distinct case when ref_id%3=0 and starts_with(image,'images/') then 'beta/'||image else image end as p from image_refs where {IMG} and ref_id%2=1) select ref_id, image as path, coalesce(a.p,b.p) as resolved from image_refs left join f a on image=a.p left join f b on 'beta/'||image=b.p where {IMG}",
    "image_refs",
)(
    lambda r: resolve.lookup_with_fallback(
        r.where(refs.has_image(F.col("image"))).select("ref_id", F.col("image").alias("path")),
        r.where(refs.has_image(F.col("image")) & (F.col("ref_id") % 2 == 1)).select(F.when((F.col("ref_id") % 3 == 0) & F.col("image").startswith("images/"), F.concat(F.lit(PREFIX), F.col("image"))).otherwise(F.col("image")).alias("path")),
        PREFIX,
    )
)
_NUM_ID = "coalesce(cast(try_cast({0} as bigint) as varchar), {0})"


def _number_or_text(path: Column) -> Column:
    return F.coalesce(refs.whole_id(path).cast("string"), refs.image_id(path))


_LAST_SQL = "l as (select dataset, split, cast(raw_id as varchar) as id, max(row_idx) as index from source_rows where raw_id is not null group by 1,2,3)"
_IDX_SQL = f"with {PJOIN_SQL}, o as (select *, {_NUM_ID.format(ID_SQL.format('path'))} as id from pj where id_field is not null), {_LAST_SQL} select o.path, o.dataset, o.split, o.id_field, o.id, l.index from o join l on o.dataset=l.dataset and o.split=l.split and o.id=l.id"
_add("id_index_join", _IDX_SQL, "image_refs", "catalog", "source_rows")(
    lambda r, c, s: resolve.id_index_join(_paths(r), c, s, _number_or_text(F.col("path"))).select("path", "dataset", "split", "id_field", "id", "index")
)
_POS_SQL = f"with {PJOIN_SQL}, o as (select *, row_number() over (partition by source, subfolder order by path)-1 as index from pj where id_field is null), z as (select dataset, split, count(*) as n from source_rows group by 1,2) select o.path, o.dataset, o.split, o.index from o join z using(dataset, split) where index<n"
_add("positional_join", _POS_SQL, "image_refs", "catalog", "source_rows")(lambda r, c, s: resolve.positional_join(_paths(r), c, s).select("path", "dataset", "split", "index"))
_add("catalog_join", "select ref_id, dataset from image_refs r join (select source, min(dataset) as dataset from catalog group by 1) c on split_part(r.image,'/',1)=c.source", "image_refs", "catalog")(
    lambda r, c: r.select("ref_id", T.first_segment(F.col("image")).alias("source")).join(c.groupBy("source").agg(F.min("dataset").alias("dataset")), "source").select("ref_id", "dataset")
)
_add("catalog_unknown_anti", f"select distinct split_part(image,'/',1) as source from image_refs where {IMG} and split_part(image,'/',1) not in (select source from catalog)", "image_refs", "catalog")(lambda r, c: refs.unknown_sources(_paths(r), c))
_add("prefix_join", f"with {PJOIN_SQL} select path, source, subfolder, dataset from pj", "image_refs", "catalog")(lambda r, c: refs.prefix_join(_paths(r), c).select("path", "source", "subfolder", "dataset"))
_add("skip_existing_anti", f"select ref_id, image as path from image_refs where {IMG} and image not in (select image from image_refs where ref_id<100 and {IMG})", "image_refs")(
    lambda r: sinks.skip_existing(r.where(refs.has_image(F.col("image"))).select("ref_id", F.col("image").alias("path")), r.where("ref_id < 100").select(F.col("image").alias("path"))).select("ref_id", "path")
)
_add("fanout_paths", f"select ref_id, unnest(['a/'||image,'b/'||image]) as target from image_refs where {IMG}", "image_refs")(
    lambda r: sinks.fan_out(r.where(refs.has_image(F.col("image"))), F.concat(F.lit("a/"), "image"), F.concat(F.lit("b/"), "image")).select("ref_id", "target")
)

# --- sinks -------------------------------------------------------------------------------

_add("sink_jsonl_line", "select conv_id, turn, '{\"conv_id\":'||conv_id||',\"turn\":'||turn||',\"role\":'||to_json(role)||'}' as line from conversations", "conversations")(
    lambda c: c.select("conv_id", "turn", sinks.json_line("conv_id", "turn", "role").alias("line"))
)
_add("mapping_json", f"with {PJOIN_SQL} select path, '{{\"dataset\":'||to_json(dataset)||',\"split\":'||to_json(split)||',\"id_field\":'||coalesce(to_json(id_field)::varchar,'null')||'}}' as json from pj", "image_refs", "catalog")(
    lambda r, c: sinks.mapping_document(refs.prefix_join(_paths(r), c).select("path", "dataset", "split", "id_field"), "path")
)

# --- statistics --------------------------------------------------------------------------

_OUT = "case when image is null then 'no_image' when split_part(image,'/',1) not in ('alpha','beta','gamma','') then 'filtered' when image='' then 'unresolved' when ref_id%11=0 then 'no_conversations' else 'processed' end"
_OUT_CTE = f"o as (select ref_id, split, image, {_OUT} as outcome, ref_id%5 as rounds from image_refs)"
_COUNTS = "count(*) filter (outcome='processed') as samples_processed, count(*) filter (outcome<>'processed') as samples_skipped, count(*) filter (outcome in ('no_image','unresolved')) as samples_no_image, count(*) filter (outcome='no_conversations') as samples_no_conversations, count(*) filter (outcome='filtered') as samples_filtered_by_source, cast(coalesce(sum(rounds) filter (outcome='processed'),0) as bigint) as total_rounds, count(*) filter (outcome in ('no_conversations','processed')) as images_saved"


def _outcomes(r: DataFrame) -> DataFrame:
    own = stats.outcome(F.col("image").isNull(), ~refs.in_sources(F.col("image"), ["alpha", "beta", "gamma", ""]), F.col("image") == "", F.col("ref_id") % 11 == 0)
    return r.select("ref_id", "split", "image", own.alias("outcome"), (F.col("ref_id") % 5).alias("rounds"))


_add("run_stats", f"with {_OUT_CTE} select split, {_COUNTS} from o group by 1", "image_refs")(lambda r: stats.run_stats(_outcomes(r)))
_add("run_stats_rollup", f"with {_OUT_CTE} select coalesce(split,'total') as split, {_COUNTS} from o group by rollup(split)", "image_refs")(lambda r: stats.run_stats_rollup(_outcomes(r)))
_add("avg_rounds", f"with {_OUT_CTE}, s as (select split, {_COUNTS} from o group by 1) select split, round(total_rounds/greatest(1,samples_processed),2) as mean_rounds from s", "image_refs")(
    lambda r: stats.run_stats(_outcomes(r)).select("split", F.round(stats.safe_mean(F.col("total_rounds"), F.col("samples_processed")), 2).alias("mean_rounds"))
)
_add("coverage_pct", f"with {PJOIN_SQL} select round(100.0*(select count(*) from pj)/nullif((select count(*) from k),0),1)::double as pct", "image_refs", "catalog")(
    lambda r, c: _paths(r).join(refs.prefix_join(_paths(r), c).select("path", F.lit(1).alias("hit")), "path", "left").agg(stats.coverage_percent(F.count("hit"), F.count("*")).cast("double").alias("pct"))
)
_add("found_missing", f"with {PJOIN_SQL} select (select count(*) from pj) as found, (select count(*) from k)-(select count(*) from pj) as missing", "image_refs", "catalog")(
    lambda r, c: _paths(r).join(refs.prefix_join(_paths(r), c).select("path", F.lit(1).alias("hit")), "path", "left").agg(F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"))
)
_add("first_errors", "select split, ref_id, 'no image: '||ref_id as message from (select *, row_number() over (partition by split order by ref_id) as n from image_refs where image is null) t where n<=100", "image_refs")(
    lambda r: stats.first_errors(r.where("image is null").select("split", F.col("ref_id").alias("idx"), F.concat(F.lit("no image: "), F.col("ref_id").cast("string")).alias("message"))).select("split", F.col("idx").alias("ref_id"), "message")
)
_add("distinct_paths", PATHS, "image_refs")(_paths)
_add("paths_by_source", f"select split_part(image,'/',1) as source, count(*) as refs, count(distinct image) as paths from image_refs where {IMG} group by 1", "image_refs")(
    lambda r: r.where(refs.has_image(F.col("image"))).groupBy(T.first_segment(F.col("image")).alias("source")).agg(F.count("*").alias("refs"), F.count_distinct("image").alias("paths"))
)
_add("group_paths_by_id", f"with k as ({PATHS}) select {ID_SQL.format('path')} as id, string_agg(path, ',' order by path) as paths from k group by 1", "image_refs")(
    lambda r: _paths(r).groupBy(refs.image_id(F.col("path")).alias("id")).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
)
_add("source_outcome", "select c.source, case when count(r.ref_id)>0 then 'ok' else 'failed' end as outcome, count(r.ref_id) as n from (select source from catalog union select 'delta') c left join image_refs r on split_part(r.image,'/',1)=c.source group by 1", "image_refs", "catalog")(
    lambda r, c: c.select("source").union(c.sparkSession.createDataFrame([("delta",)], "source string")).distinct().join(r.select("ref_id", T.first_segment(F.col("image")).alias("source")), "source", "left")
    .groupBy("source").agg(F.when(F.count("ref_id") > 0, "ok").otherwise("failed").alias("outcome"), F.count("ref_id").alias("n"))
)
_add("last_index_per_id", f"with {_LAST_SQL} select * from l", "source_rows")(resolve.last_index_per_id)
_add("row_count", "select count(*) as n from lineitem", "lineitem")(lambda t: t.agg(F.count("*").alias("n")))

# --- turns -------------------------------------------------------------------------------

_add("pair_alternating", f"with {PAIRS_SQL} select * from x", "conversations")(pairing.pair_alternating)
_add("reflective_rounds", f"with {ROUNDS_SQL} select * from r", "refl_turns")(pairing.reflective_rounds)
_add("reflective_exchanges", f"{EXCHANGE_SQL} select * from x", "refl_turns", "conversations")(lambda t, c: pairing.reflective_exchanges(pairing.reflective_rounds(t), _questions(c)))
_add("dropped_rounds", f"with {NUMBERED_SQL} select conv_id, round, turn from n where round>0 and coalesce(before,'')=''", "refl_turns")(lambda t: pairing.dropped_rounds(pairing.reflective_rounds(t)))
_add("rounds_per_dialogue", f"{EXCHANGE_SQL} select conv_id, count(*) as rounds from x group by 1", "refl_turns", "conversations")(
    lambda t, c: pairing.chat_rows(pairing.reflective_exchanges(pairing.reflective_rounds(t), _questions(c)), "round", SYSTEM).select("conv_id", F.size("conversation").cast("bigint").alias("rounds"))
)
def _state_action(n: int) -> None:
    past = f"(select coalesce(string_agg('User: '||b.human||chr(10)||'Assistant: '||b.assistant||chr(10),'' order by b.round),'') from y b where b.conv_id=a.conv_id and b.round<a.round and b.round>=a.round-{n})"
    sql = f"with {PAIRS_SQL}, y as (select *, row_number() over (partition by conv_id order by turn)-1 as round from x) select conv_id, round, least(round,{n}) as n_history, '<image>'||chr(10)||{past}||'User: '||human as state, assistant as action, {IMAGE_SQL} as images from y a"
    name = "state_action" if n == pairing.HISTORY else f"state_action_{n}"
    _add(name, sql, "conversations")(
        lambda c: pairing.state_action(pairing.pair_alternating(c), n, conversation_images(c)).select(
            "conv_id", "round", "n_history", F.get("messages", F.lit(0))["content"].alias("state"), F.get("messages", F.lit(1))["content"].alias("action"), F.array_join("images", ",").alias("images")
        )
    )


_state_action(pairing.HISTORY)
_state_action(2)
_add("enumerate_rows", "select ref_id, row_number() over (order by ref_id)-1 as idx from image_refs", "image_refs")(lambda r: order.with_position(r, "ref_id").select("ref_id", "idx"))
_add("rank_paths", f"with {PJOIN_SQL} select source, subfolder, path, row_number() over (partition by source, subfolder order by path)-1 as rank from pj", "image_refs", "catalog")(lambda r, c: resolve.rank_paths(_paths(r), c))

# --- heads and sets ----------------------------------------------------------------------

_add("head_n", "select ref_id, image from image_refs order by ref_id limit 50", "image_refs")(lambda r: order.head(r, "ref_id", 50).select("ref_id", "image"))
_add("head_n_per_split", "select split, ref_id from (select *, row_number() over (partition by split order by ref_id) as n from image_refs) t where n<=20", "image_refs")(lambda r: order.head(r, "ref_id", 20, ["split"]).select("split", "ref_id"))
_add("limit_after_filter", f"select ref_id, image from image_refs where {IMG} order by ref_id limit 50", "image_refs")(lambda r: order.head_after(r, refs.has_image(F.col("image")), "ref_id", 50).select("ref_id", "image"))
_add("preview_missing", "select ref_id from image_refs where image is null order by ref_id limit 10", "image_refs")(lambda r: order.head_after(r, F.col("image").isNull(), "ref_id", 10).select("ref_id"))
_SETS = ("(select distinct image as path from image_refs where ref_id%2=0 and " + IMG + ")", "(select distinct image as path from image_refs where ref_id%3=0 and " + IMG + ")")
for _name, _word, _op in (("union_distinct", "union", lambda a, b: a.union(b).distinct()), ("except_known", "except", lambda a, b: a.subtract(b)), ("intersect_needed", "intersect", lambda a, b: a.intersect(b))):
    _add(_name, f"{_SETS[0]} {_word} {_SETS[1]}", "image_refs")(lambda r, op=_op: op(_paths(r.where("ref_id % 2 = 0")), _paths(r.where("ref_id % 3 = 0"))))
_add("keyed_merge", "select coalesce(b.doc_id,a.doc_id) as doc_id, coalesce(b.v,a.v) as v from (select doc_id, source as v from documents where doc_id%2=0) a full join (select doc_id, lang as v from documents where doc_id%3=0) b on a.doc_id=b.doc_id", "documents")(
    lambda d: resolve.keyed_merge([d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("v")), d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("v"))], "doc_id")
)

# --- scalar functions --------------------------------------------------------------------

_scalar("fn_strip", lambda: {"s": T.strip(F.concat(F.lit(" \t　"), F.col("value"), F.lit("\x1f\n ")))}, f"trim(' '||chr(9)||chr(12288)||value||chr(31)||chr(10)||' ',{WS}) as s", "refl_turns", "conv_id, turn")
_scalar("fn_rstrip_dot", lambda: {"s": T.rstrip_dots(F.col("value"))}, "rtrim(value,'.') as s", "refl_turns", "conv_id, turn")
_scalar("fn_after_marker", lambda: {"a": T.after_marker(F.col("value"), "Answer:"), "f": T.after_marker(F.col("value"), "Feedback:")}, f"{_after('value', 'Answer:')} as a, {_after('value', 'Feedback:')} as f", "refl_turns", "conv_id, turn")
_scalar("fn_first_line", lambda: {"s": T.first_line(F.col("value"))}, "split_part(value,chr(10),1) as s", "refl_turns", "conv_id, turn")
_scalar("fn_path_segments", lambda: {"a": T.first_segment(F.col("url")), "z": T.last_segment(F.col("url"))}, "split_part(url,'/',1) as a, split_part(url,'/',-1) as z", "pages", "page_id")
_scalar("fn_strip_ext", lambda: {"s": T.strip_extension(F.col("url"))}, "regexp_replace(url,'\\.[^.]*$','') as s", "pages", "page_id")
_scalar("fn_affix", lambda: {"a": F.col("url").startswith("https"), "b": F.col("url").endswith("x"), "c": F.contains(F.col("url"), F.lit("/de/"))}, "starts_with(url,'https') as a, suffix(url,'x') as b, contains(url,'/de/') as c", "pages", "page_id")
_scalar("fn_parse_score", lambda: {"score": T.score_of(F.col("value"))}, f"{_number(_SCORE_TEXT)} as score", "refl_turns", "conv_id, turn")
_scalar("extract_answer", lambda: {"answer": T.extract_answer(F.col("value"))}, f"{ANSWER_SQL} as answer", "refl_turns", "conv_id, turn")
_add("extract_feedback", f"select conv_id, turn, {FEEDBACK_SQL} as feedback from refl_turns where role='teacher'", "refl_turns")(lambda t: t.where("role = 'teacher'").select("conv_id", "turn", T.extract_feedback(F.col("value")).alias("feedback")))
_scalar("fn_zero_pad", lambda: {"a": T.zero_pad(F.col("doc_id"), 6), "b": T.zero_pad(F.col("doc_id") * 10000000, 6)}, "printf('%06d',doc_id) as a, printf('%06d',doc_id*10000000) as b", "documents", "doc_id")
_scalar("fn_array", lambda: {"n": F.size(F.split("url", "/")).cast("bigint"), "first": F.get(F.split("url", "/"), F.lit(0)), "some": F.array_join(F.slice(F.split("url", "/"), 1, 2), "|")}, "len(split(url,'/')) as n, split(url,'/')[1] as first, array_to_string(list_slice(split(url,'/'),1,2),'|') as some", "pages", "page_id")
def _named() -> Column:
    return F.struct(F.col("role").alias("r"), F.col("text").alias("t"))


_scalar("fn_struct_get", lambda: {"r": _named()["r"], "t": F.coalesce(_named()["t"], F.lit(""))}, "struct_pack(r:=role,t:=text).r as r, coalesce(struct_pack(r:=role,t:=text).t,'') as t", "conversations", "conv_id, turn")
_scalar("fn_json_get", lambda: {"k": V.json_get(F.col("props"), "k"), "has": V.json_has(F.col("props"), "k"), "no": V.json_has(F.col("props"), "z")}, "json_extract_string(props,'$.k') as k, list_contains(json_keys(props),'k') as has, list_contains(json_keys(props),'z') as no", "events", "event_id")
_scalar("fn_base64", lambda: {"b": V.decode_base64(F.base64(F.col("source").cast("binary"))).cast("string")}, "source as b", "documents", "doc_id")
_scalar("fn_kind", lambda: {"k": V.payload_kind(F.col("image"))}, _KIND_SQL.format("image") + " as k", "image_refs", "ref_id")

from . import preparation  # noqa: E402,F401  registers its own queries
