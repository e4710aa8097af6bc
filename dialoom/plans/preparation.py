"""Queries of sources, typed lookups, rejects, sinks and the whole preparation, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions import values as V
from dialoom.operators import order, pairing, refs, resolve, stats
from dialoom.sources import readers, sinks, staged
from dialoom.sources.shared import shared_path as _shared

from .fixtures import view
from .prepare import Prepared, prepare
from .queries import (
    EXCHANGE_SQL,
    IMAGE_SQL,
    IMG,
    PAIRS_SQL,
    PJOIN_SQL,
    PREFIX,
    QUERIES,
    SQL,
    SYSTEM,
    WS,
    _add,
    _COUNTS,
    _OUT_CTE,
    _outcomes,
    _paths,
    _questions,
    _scalar,
    conversation_images,
)

# --- scans -------------------------------------------------------------------------------


def _scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = readers.read_split(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


QUERIES["scan_split"] = _scan_split
SQL["scan_split"] = """
select event_type, count(*) as n, min(event_id) as first_id
from events
group by 1
"""


def _scan_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits below a named configuration; of several listed ones, the first is read."""
    root = _shared(spark, "configs")
    for split in readers.choose_splits(["test", "train"]):
        rest = F.lit(0) if split == "test" else F.pmod("doc_id", F.lit(10))
        view(spark, sf_dir, "documents").where((F.col("doc_id") % 10 == 0) == (split == "test")).select("doc_id", rest.alias("rest")).write.parquet(f"{root}/small/{split}.parquet")
    listed = [(s, readers.read_split(spark, root, s, "small")) for s in ("train", "test")]
    return readers.first_split(listed)


QUERIES["scan_first_split"] = _scan_config
SQL["scan_first_split"] = "select doc_id, doc_id % 10 as rest from documents where doc_id % 10 <> 0"


def _scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "turns.jsonl")
    sinks.write_jsonl(view(spark, sf_dir, "conversations"), path)
    rows = readers.local_else(spark, f"{path}.missing", lambda p: readers.read_dialogues(spark, p, "conv_id long, turn long, role string, text string"), path)
    return rows.select("conv_id", "turn", "role", F.length("text").alias("n"))


QUERIES["scan_jsonl"] = _scan_jsonl
SQL["scan_jsonl"] = "select conv_id, turn, role, length(text) as n from conversations"


def _scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document that lists rows and one that is a single row, of two tables of fixed size; the format is found by trying."""
    nation = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    one = view(spark, sf_dir, "region").where("r_regionkey = 0").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    listed, single = _shared(spark, "list"), _shared(spark, "single")
    nation.agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", "name"))), {"pretty": "true"})).coalesce(1).write.text(listed)
    one.select(F.to_json(F.struct("key", "name"), {"pretty": "true"})).coalesce(1).write.text(single)
    read = [(kind, readers.read_dialogues(spark, path, "key long, name string")) for kind, path in (("list", listed), ("single", single))]
    return readers.union_splits(read).select(F.col("split").alias("kind"), "key", "name")


QUERIES["scan_json_document"] = _scan_json
SQL["scan_json_document"] = """
select 'list' as kind, n_nationkey as key, n_name as name from nation
union all
select 'single', r_regionkey, r_name from region where r_regionkey = 0
"""
QUERIES["selector_head"] = lambda spark, sf_dir: readers.read_selected(spark, sf_dir, "documents#50", "doc_id").select("doc_id", "source")
SQL["selector_head"] = "select doc_id, source from documents order by doc_id limit 50"


# --- payloads ----------------------------------------------------------------------------


def _payload() -> Column:
    """An image in each of the forms that a row may give it in."""
    i, body = F.col("ref_id") % 7, F.base64(F.concat(F.lit("img"), F.col("ref_id").cast("string")).cast("binary"))
    forms = [
        F.col("image"), F.concat(F.lit("data:image/png;base64,"), body), body, F.concat(F.lit('{"bytes":"'), body, F.lit('"}')),
        F.concat(F.lit('{"path":"a/'), F.col("ref_id").cast("string"), F.lit('.png"}')), F.concat(F.lit("http://x/"), F.col("ref_id").cast("string")), F.lit("{}"),
    ]
    out = forms[0]
    for k, form in enumerate(forms[1:], 1):
        out = F.when(i == k, form).otherwise(out)
    return out


_scalar(
    "image_payload_forms",
    lambda: {"kind": V.payload_kind(_payload()), "bytes": V.payload_bytes(_payload()).cast("string"), "path": V.payload_path(_payload())},
    """
    case ref_id % 7
      when 1 then 'data_uri' when 2 then 'base64' when 3 then 'dict_bytes' when 4 then 'dict_path' when 5 then 'url' when 6 then 'unknown'
      else case when image is null then 'missing' when image = '' then 'empty' else 'path' end
    end as kind,
    case when ref_id % 7 in (1, 2, 3) then 'img' || ref_id end as bytes,
    case when ref_id % 7 = 4 then 'a/' || ref_id || '.png' when ref_id % 7 = 0 and image <> '' then image end as path
    """,
    "image_refs",
    "ref_id",
)
_scalar(
    "target_mode",
    lambda: {"ext": refs.extension_for_mode(F.when(F.col("ref_id") % 3 == 0, "RGB").when(F.col("ref_id") % 3 == 1, "RGBA"))},
    "case when ref_id % 3 = 0 then '.jpg' else '.png' end as ext",
    "image_refs",
    "ref_id",
)

# --- key presence and rejects ------------------------------------------------------------

_ID_NAMES = ["pid", "question_id", "id", "image_id"]


def _id_row() -> Column:
    """A JSON row in which ids stand under different keys, some of them null."""
    i, n = F.col("ref_id") % 6, F.col("ref_id").cast("string")
    return (
        F.when(i == 0, F.concat(F.lit('{"id":'), n, F.lit(',"image_id":1}')))
        .when(i == 1, F.concat(F.lit('{"id":'), n, F.lit(',"pid":null}')))
        .when(i == 2, F.concat(F.lit('{"image_id":"x'), n, F.lit('"}')))
        .when(i == 3, F.concat(F.lit('{"question_id":"","id":'), n, F.lit("}")))
        .when(i == 4, F.lit('{"other":1}'))
        .otherwise(F.concat(F.lit('{"pid":"p'), n, F.lit('","id":2}')))
    )


_scalar(
    "first_present_id",
    lambda: {"id": V.first_present(_id_row(), _ID_NAMES)},
    """
    case ref_id % 6
      when 0 then cast(ref_id as varchar) when 1 then 'None' when 2 then 'x' || ref_id when 3 then '' when 4 then null else 'p' || ref_id
    end as id
    """,
    "image_refs",
    "ref_id",
)
_scalar(
    "role_coalesce",
    lambda: {
        "r": V.keyed_else(
            F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"from":"'), F.col("role"), F.lit('","role":"other"}')))
            .when(F.col("turn") % 3 == 1, F.concat(F.lit('{"role":"'), F.col("role"), F.lit('"}')))
            .otherwise(F.lit('{"from":null,"role":"user"}')),
            "from",
            "role",
        )
    },
    "case when turn % 3 = 2 then null else role end as r",
    "conversations",
    "conv_id, turn",
)
_scalar(
    "extract_question",
    lambda: {
        "question": V.question_text(
            F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.concat(F.lit(" "), F.col("text")).alias("value"))))
            .when(F.col("turn") % 4 == 1, F.concat(F.lit('"'), F.col("role"), F.lit(' "')))
            .when(F.col("turn") % 4 == 2, F.col("conv_id").cast("string"))
        )
    },
    f"case turn % 4 when 0 then trim(text, {WS}) when 1 then role when 2 then cast(conv_id as varchar) else 'None' end as question",
    "conversations",
    "conv_id, turn",
)
_scalar(
    "reject_rows",
    lambda: {"number": _number().try_cast("bigint"), "reject": F.when(_number().try_cast("bigint").isNull(), F.concat(F.col("event_id").cast("string"), F.lit(": not a number: "), _number()))},
    """
    case when event_id % 4 <> 0 then event_id * 3 end as number,
    case when event_id % 4 = 0 then event_id || ': not a number: ' || 'x' || event_id end as reject
    """,
    "events",
    "event_id",
)


def _number() -> Column:
    return F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise((F.col("event_id") * 3).cast("string"))


def _dialogues(labels: DataFrame, conversations: DataFrame) -> DataFrame:
    """A dialogue for each label, most without turns, some without a question."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    own = labels.select(F.col("doc_id").alias("conv_id")).join(turns, "conv_id", "left")
    return own.withColumn("question", F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("q"), F.col("conv_id").cast("string"))))


_add(
    "filter_nonempty_dialogue",
    """
    with n as (select conv_id, count(*) as n from conversations group by 1)
    select l.doc_id as conv_id, coalesce(n, 0) as n_turns,
      case when n is null then 'no conversations' when l.doc_id % 3 = 0 then 'no question' end as reject
    from labels l left join n on l.doc_id = n.conv_id
    """,
    "labels",
    "conversations",
)(
    lambda n, c: _dialogues(n, c).select(
        "conv_id", F.coalesce(F.size("turns"), F.lit(0)).cast("bigint").alias("n_turns"), pairing.dialogue_reject(F.col("turns"), F.col("question")).alias("reject")
    )
)

# --- typed lookups -----------------------------------------------------------------------

# The one source whose path ids are whole numbers, and its dataset.
_NUMBER_SOURCES, _NUMBER_DATASETS = ["alpha"], ["ds_alpha"]
_TYPED_SQL = f"""
{PJOIN_SQL},
names as (
  select path, source, dataset, split, id_field, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') as name
  from pj where id_field is not null
),
p as (
  select path, source, dataset, split, id_field,
    case when source = 'alpha' and regexp_matches(name, '^[+-]?[0-9]+$') then 'int' else 'text' end as kind,
    case when source = 'alpha' and regexp_matches(name, '^[+-]?[0-9]+$') then cast(try_cast(name as bigint) as varchar) else name end as id
  from names
),
s as (
  select dataset, split, row_idx, has_image, cast(raw_id as varchar) as id,
    case when dataset = 'ds_alpha' then 'int' else id_kind end as kind
  from source_rows where raw_id is not null
)
"""


def _typed(r: DataFrame, c: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolve.typed_path_ids(_paths(r), c, _NUMBER_SOURCES), resolve.typed_row_ids(s, _NUMBER_DATASETS)


def _typed_join(r: DataFrame, c: DataFrame, s: DataFrame) -> DataFrame:
    paths, rows = _typed(r, c, s)
    key = ["dataset", "split", "kind", "id"]
    last = rows.groupBy(*key).agg(F.max("row_idx").alias("index"))
    return paths.join(last, key).select("path", "dataset", "split", "kind", "id", "index")


_add(
    "typed_id_join",
    f"""
    with {_TYPED_SQL}
    select p.path, p.dataset, p.split, p.kind, p.id, max(s.row_idx) as index
    from p join s on p.dataset = s.dataset and p.split = s.split and p.kind = s.kind and p.id = s.id
    group by all
    """,
    "image_refs",
    "catalog",
    "source_rows",
)(_typed_join)


def _first_match(r: DataFrame, c: DataFrame, s: DataFrame) -> DataFrame:
    ordered = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return resolve.first_match(*_typed(r, c, s), ordered).select("path", "dataset", "kind", "id", "split", "index")


_add(
    "first_match_join",
    f"""
    with {_TYPED_SQL},
    m as (
      select p.path, p.dataset, p.kind, p.id, s.split, s.row_idx as index,
        row_number() over (
          partition by p.path, p.dataset order by case s.split when 'train' then 0 when 'val' then 1 else 2 end, s.row_idx
        ) as nth
      from p join s on p.dataset = s.dataset and p.kind = s.kind and p.id = s.id
      where s.has_image
    )
    select path, dataset, kind, id, split, index from m where nth = 1
    """,
    "image_refs",
    "catalog",
    "source_rows",
)(_first_match)
_add(
    "until_found",
    "select doc_id from documents where doc_id in (select doc_id from labels where toxic = 1)",
    "documents",
    "labels",
)(lambda d, n: order.until_found(d.select("doc_id"), n.where("toxic = 1"), "doc_id"))



def _event_splits(spark: SparkSession, sf_dir: str) -> list[str]:
    """Two splits of the events, each of numbered files in the order of the events; some users are in the second alone."""
    paths, second = [], (F.col("event_id") % 3 == 0) | (F.col("user_id") % 10 == 0)
    for split, own in (("train", ~second), ("val", second)):
        paths.append(_shared(spark, f"{split}.parquet"))
        view(spark, sf_dir, "events").where(own).repartitionByRange(16, "event_id").sortWithinPartitions("event_id").write.parquet(paths[-1])
    return paths


def _until_found(keep: str, needed: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = staged.read_until_found(spark, _event_splits(spark, sf_dir), needed(view(spark, sf_dir, "events")), "user_id", keep, first_files=1)
        return rows.select("user_id", "event_id", "event_type", "split_ord")

    return run


def _until_found_sql(needed: str, pick: str) -> str:
    """Rows numbered over both splits; the stop is the greatest first place, if each needed key has one."""
    return f"""
    with needed as ({needed}),
    placed as (
      select user_id, event_id, event_type, case when event_id % 3 = 0 or user_id % 10 = 0 then 1 else 0 end as split_ord,
        row_number() over (order by case when event_id % 3 = 0 or user_id % 10 = 0 then 1 else 0 end, event_id) as pos
      from events
    ),
    hits as (select * from placed where user_id in (select user_id from needed)),
    stop as (
      select case when count(*) = (select count(*) from needed) then max(first_pos) end as pos
      from (select user_id, min(pos) as first_pos from hits group by 1)
    ),
    ranked as (
      select h.*, row_number() over (partition by user_id order by h.pos {pick}) as nth
      from hits h, stop where stop.pos is null or h.pos <= stop.pos
    )
    select user_id, event_id, event_type, split_ord from ranked where nth = 1
    """


# Users of the first events of the first split end the scan there; those whom it hasn't lead to the second, and a user of no event to the ends of both.
QUERIES["scan_until_found"] = _until_found("last", lambda e: e.where("event_id < 60 and user_id % 10 <> 0").select("user_id"))
SQL["scan_until_found"] = _until_found_sql("select distinct user_id from events where event_id < 60 and user_id % 10 <> 0", "desc")
QUERIES["scan_second_split"] = _until_found("last", lambda e: e.where("event_id < 600 and (event_id < 60 or user_id % 10 = 0)").select("user_id"))
SQL["scan_second_split"] = _until_found_sql("select distinct user_id from events where event_id < 600 and (event_id < 60 or user_id % 10 = 0)", "desc")
QUERIES["scan_never_found"] = _until_found("first", lambda e: e.select("user_id").union(e.select(F.max("user_id") + 1)))
SQL["scan_never_found"] = _until_found_sql("select distinct user_id from events union select max(user_id) + 1 from events", "asc")

# --- sinks and statistics ----------------------------------------------------------------


def _jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that were written, nulls and texts beyond ASCII as they are."""
    path = _shared(spark, "lines.jsonl")
    rows = view(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("é"), F.col("source"))).alias("s"))
    sinks.write_jsonl(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


QUERIES["sink_jsonl"] = _jsonl_lines
SQL["sink_jsonl"] = """
select '{"doc_id":' || doc_id || ',"lang":"' || lang || '","s":' || case when doc_id % 5 <> 0 then '"é' || source || '"' else 'null' end || '}' as line
from documents
"""


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order of the documents over numbered files, read again by their manifest."""
    path = _shared(spark, "ordered")
    rows = view(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), "lang", "text")
    sinks.write_ordered(rows, path, "doc_id", file_bytes=32 << 20)
    return sinks.read_ordered(spark, path).select("line_no", F.get_json_object("line", "$.id").cast("bigint").alias("id"), F.get_json_object("line", "$.lang").alias("lang"), F.md5(F.get_json_object("line", "$.text")).alias("md5"))


QUERIES["sink_ordered"] = _ordered_lines
SQL["sink_ordered"] = "select row_number() over (order by doc_id) - 1 as line_no, doc_id as id, lang, md5(text) as md5 from documents"


def _written_stats(turns: DataFrame, conversations: DataFrame, r: DataFrame) -> DataFrame:
    """Counters that were taken while the rows were written."""
    spark = r.sparkSession
    told = _prepared(turns, conversations, r).write(_shared(spark, "prepared"), file_bytes=32 << 20)
    return spark.createDataFrame([(s, *own.values()) for s, own in told.items()], "split string, " + ", ".join(f"{c} long" for c in stats.COUNTERS))


_COUNTERS = [c.split(" as ")[-1].strip() for c in _COUNTS.replace("cast(coalesce(sum(rounds) filter (outcome='processed'),0) as bigint)", "x").split(", ")]
_STATS_SQL = f"""
o as (select *, row_number() over (partition by split, outcome order by ref_id) as nth from (select * from outcomes) t),
s as (select split, {_COUNTS} from outcomes group by 1),
e as (select split, string_agg('"no_image: ' || ref_id || '"', ',' order by ref_id) as errors from o where outcome = 'no_image' and nth <= 100 group by 1)
"""


def _document_sql(entries: str) -> str:
    counters = " || ',' || ".join(f"'\"{c}\":' || {c}" for c in _COUNTERS)
    return f"""
    select '{{' || string_agg('"' || split || '":{{' || {counters} || ',"errors":[' || coalesce(errors, '') || ']}}', ',' order by split) || '}}' as json
    from {entries}
    """


def _stats_document(r: DataFrame) -> DataFrame:
    own = _outcomes(r)
    missing = own.where("outcome = 'no_image'").select("split", F.col("ref_id").alias("idx"), F.concat(F.lit("no_image: "), F.col("ref_id").cast("string")).alias("message"))
    return sinks.stats_document(stats.stats_by_split(own, missing))


_add("stats_json", f"with {_OUT_CTE.replace('o as', 'outcomes as', 1)}, {_STATS_SQL} {_document_sql('s left join e using (split)')}", "image_refs")(_stats_document)
_add(
    "summary_log",
    f"""
    with {_OUT_CTE}, s as (select split, {_COUNTS} from o group by 1)
    select split, split || ': ' || samples_processed || ' processed, ' || samples_skipped || ' skipped, ' || samples_no_image || ' without image, '
      || printf('%.2f', total_rounds / greatest(1, samples_processed)) || ' rounds on average' as line
    from s
    """,
    "image_refs",
)(lambda r: stats.summary_lines(stats.run_stats(_outcomes(r))))
_scalar(
    "effective_batch",
    lambda: {"rows": stats.effective_batch(F.col("n_nationkey"), F.lit(16), F.col("n_regionkey"))},
    "n_nationkey * 16 * n_regionkey as rows",
    "nation",
    "n_nationkey",
)

# --- the whole preparation ---------------------------------------------------------------

_add(
    "chat_rows",
    f"""
    with {PAIRS_SQL}
    select conv_id, '{SYSTEM}' as system, count(*) as n, string_agg(human || '|' || assistant, '~' order by turn) as conversation, {IMAGE_SQL} as images
    from x group by 1
    """,
    "conversations",
)(lambda c: _told(pairing.chat_rows(pairing.pair_alternating(c), "turn", SYSTEM, conversation_images(c)), "conv_id", "system"))


def _told(rows: DataFrame, *columns: str) -> DataFrame:
    """Chat rows with their lists as texts."""
    spoken = F.array_join(F.transform("conversation", lambda s: F.concat(s["human"], F.lit("|"), s["assistant"])), "~")
    return rows.select(*columns, F.size("conversation").cast("bigint").alias("n"), spoken.alias("conversation"), F.array_join("images", ",").alias("images"))


def _found(r: DataFrame) -> DataFrame:
    """Two paths in three, those of the prefix's own folder under their full names."""
    own = r.where(refs.has_image(F.col("image")) & (F.col("ref_id") % 3 != 0))
    return own.select(F.when(F.col("image").startswith("images/"), F.concat(F.lit(PREFIX), "image")).otherwise(F.col("image")).alias("path")).distinct()


def _prepared(turns: DataFrame, conversations: DataFrame, r: DataFrame) -> Prepared:
    numbered = order.with_position(r, "ref_id", "idx", ["split"])  # ids begin again in each split
    images = numbered.select(F.col("idx").alias("conv_id"), "split", "idx", "image")
    return prepare(turns, _questions(conversations), images, _found(r), ["alpha", "beta", "images", ""], PREFIX, SYSTEM)


_PREPARED_SQL = f"""
{EXCHANGE_SQL},
f as (
  select distinct case when starts_with(image, 'images/') then '{PREFIX}' || image else image end as p
  from image_refs where {IMG} and ref_id % 3 <> 0
),
c as (select conv_id, count(*) as rounds, string_agg(human || '|' || assistant, '~' order by round) as conversation from x group by 1),
numbered as (select *, row_number() over (partition by split order by ref_id) - 1 as idx from image_refs),
outcomes as (
  select r.idx, r.split, coalesce(a.p, b.p) as resolved, coalesce(c.rounds, 0) as rounds, c.conversation,
    case when image is null then 'no_image' when split_part(image, '/', 1) not in ('alpha', 'beta', 'images', '') then 'filtered'
      when coalesce(a.p, b.p) is null then 'unresolved' when c.conv_id is null then 'no_conversations' else 'processed' end as outcome
  from numbered r left join f a on r.image = a.p left join f b on '{PREFIX}' || r.image = b.p left join c on c.conv_id = r.idx
)
"""
_add(
    "prepare_rows",
    f"{_PREPARED_SQL} select split, idx as conv_id, '{SYSTEM}' as system, rounds as n, conversation, resolved as images from outcomes where outcome = 'processed'",
    "refl_turns",
    "conversations",
    "image_refs",
)(lambda t, c, r: _told(_prepared(t, c, r).rows, "split", "conv_id", "system"))
_add(
    "prepare_stats",
    f"""
    {_PREPARED_SQL},
    failed as (
      select split, idx, outcome, row_number() over (partition by split order by idx) as nth
      from outcomes where outcome not in ('processed', 'filtered')
    ),
    s as (select split, {_COUNTS} from outcomes group by 1),
    listed as (select split, string_agg('"' || outcome || ': ' || split || '_' || printf('%06d', idx) || '"', ',' order by idx) as errors from failed where nth <= 100 group by 1)
    {_document_sql('s left join listed using (split)')}
    """,
    "refl_turns",
    "conversations",
    "image_refs",
)(lambda t, c, r: sinks.stats_document(_prepared(t, c, r).stats()))
_add(
    "prepare_write",
    f"{_PREPARED_SQL} select split, {_COUNTS} from outcomes group by 1",
    "refl_turns",
    "conversations",
    "image_refs",
)(_written_stats)
