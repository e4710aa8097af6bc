"""Derived views over the base tables, as SQL for either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VIEWS = {
    "refl_turns": """select conv_id, turn,
 case when role='assistant' then 'student' when role='user' and conv_id%5<>0 then 'teacher' else 'other' end as role,
 case when role='assistant' then 'response' when role='user' then 'feedback' else 'other' end as kind,
 case when role='assistant' then case when conv_id%7=6 and turn%4=1 then 'Thought: t'||chr(10)||'Answer: ' when conv_id%7=5 then text else 'Thought: t'||chr(10)||'Answer: '||text||chr(10) end
      when conv_id%7=0 then 'Feedback: '||text
      when conv_id%7=1 then 'Score: 6.5.'||chr(10)||'Feedback: '||text
      when conv_id%7=2 then 'Score: 7/10'||chr(10)||'Feedback: '||text
      when conv_id%7=3 then 'Score: 4.'||chr(10)||'Feedback: '
      when conv_id%7=4 then 'Score: 3.'
      else 'Score: '||cast((conv_id+turn)%10 as string)||'.'||chr(10)||'Feedback: '||text||chr(10) end as value
 from conversations""",
    "image_refs": """select doc_id as ref_id, case when doc_id%10=0 then 'test' else 'train' end as split,
 case doc_id%8 when 0 then 'alpha/train/'||lpad(cast(cast(floor(doc_id/16) as bigint) as string),12,'0')||'.jpg'
  when 1 then 'alpha/val/'||lpad(cast(cast(floor(doc_id/16) as bigint) as string),12,'0')||'.jpg'
  when 2 then 'beta/images/'||cast(cast(floor(doc_id/16) as bigint) as string)||'.jpg'
  when 3 then 'images/'||cast(cast(floor(doc_id/16) as bigint) as string)||'.jpg'
  when 4 then 'gamma/pics/n'||cast(doc_id as string)||'.tar.png'
  when 5 then null when 6 then '' else source||'/'||lang||'/'||cast(doc_id as string)||'.jpg' end as image
 from documents""",
    "catalog": """select * from (values ('alpha','train','ds_alpha','train','id'),('alpha','val','ds_alpha','val','id'),('beta','images','ds_beta','test','pid'),('gamma','pics','ds_gamma','train',cast(null as string))) as t(source,subfolder,dataset,split,id_field)""",
    "source_rows": """select 'ds_alpha' as dataset, case when p_partkey%3=0 then 'val' else 'train' end as split, p_partkey as row_idx, cast(p_partkey%50 as bigint) as raw_id,
 case when p_partkey%4=0 then 'text' else 'int' end as id_kind, p_partkey%13<>0 as has_image from part
 union all select 'ds_beta','test',p_partkey,case when p_partkey%11=0 then null else p_partkey%40 end, case when p_partkey%2=0 then 'text' else 'int' end, p_partkey%13<>0 from part
 union all select 'ds_gamma','train',p_partkey,null,'text',true from part where p_partkey<60""",
}
_TABLE = {"refl_turns": "conversations", "image_refs": "documents", "source_rows": "part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if base := _TABLE.get(name):
        return spark.sql(_VIEWS[name].replace(f"from {base}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    return spark.sql(_VIEWS[name])


def with_views(sql: str) -> str:
    """The SQL with the derived views that it names, for DuckDB."""
    sql = sql.strip()
    used = [k for k in _VIEWS if k in sql]
    ctes = ", ".join(f"{k} as ({_VIEWS[k]})" for k in used).replace(" as string)", " as varchar)")
    if not used:
        return sql
    return f"with {ctes}, {sql[5:]}" if sql.startswith("with ") else f"with {ctes} {sql}"
