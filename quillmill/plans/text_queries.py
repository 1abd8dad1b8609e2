"""Queries of the text functions (survey section B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import strings as S
from quillmill.functions.text import normalize_native, words_native
from quillmill.operators.dedup import Norm
from quillmill.plans.registry import core
from quillmill.plans.sqltext import norm, toks, words
from quillmill.session import table

# Words that no keyword begins with.
STOP = ["the", "this", "these", "those", "what", "when", "where", "which", "that", "then"]


@core.exact
@core.query("normalize_docs", f"select doc_id, {norm('text')} as norm from documents")
def normalize_docs(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """B1 over the crawl."""
    return table(spark, d, "documents").select("doc_id", form("text").alias("norm"))


@core.exact
@core.query(
    "shingles",
    f"""with w as (select doc_id, {words('text')} as w from documents where text is not null),
    g as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
      else list_distinct(list_transform(range(1, greatest(length(array_to_string(w, '')) - least(8, greatest(3, length(array_to_string(w, '')))) + 1, 1) + 1),
        lambda i: substr(array_to_string(w, ''), i, least(8, greatest(3, length(array_to_string(w, ''))))))) end as g from w)
    select doc_id, unnest(g) as gram from g""",
)
def shingles(spark: SparkSession, d: str, form: Norm = normalize_native) -> DataFrame:
    """B2, one row a distinct gram."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.explode(S.normalized_grams(form("text"))).alias("gram")).distinct()


@core.query("tokens", f"select doc_id, cast(len({toks('text')}) as bigint) as n, array_to_string({toks('text')}, ' ') as tokens from documents where text is not null")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    """B3."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", S.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


@core.query(
    "skill_text",
    r"""select skill_id, concat_ws(chr(10), nullif(name, ''), nullif(description, ''), nullif(content, '')) as text,
    coalesce(nullif(trim(name), ''), 'Unnamed skill') as display, regexp_replace(skill_id, '_[^_]*$', '') as dataset from skill_corpus""",
)
def skill_text(spark: SparkSession, d: str) -> DataFrame:
    """B4, B5, B10."""
    t = table(spark, d, "skill_corpus")
    return t.select(
        "skill_id",
        S.skill_text(F.col("name"), F.col("description"), F.col("content")).alias("text"),
        S.display_name(F.col("name")).alias("display"),
        S.dataset_of(F.col("skill_id")).alias("dataset"),
    )


@core.query(
    "task_ids",
    f"""with t as (select distinct instance_id, question, gold_skill_ids[1] as skill from synthetic_task where question is not null and gold_skill_ids[1] is not null)
    select instance_id, 'task_' || substr(sha256(skill || chr(0) || {norm('question')}), 1, 20) as task_id,
      'syn_' || substr(sha256({norm('question')}), 1, 20) as pool_id from t""",
)
def task_ids(spark: SparkSession, d: str) -> DataFrame:
    """B11 and the pool ids."""
    skill = F.get("gold_skill_ids", F.lit(0))
    t = table(spark, d, "synthetic_task").where(F.col("question").isNotNull() & skill.isNotNull()).select("instance_id", "question", skill.alias("skill")).distinct()
    n = normalize_native("question")
    return t.select("instance_id", S.short_hash(F.col("skill"), n, prefix="task_").alias("task_id"), S.short_hash(n, prefix="syn_").alias("pool_id"))


@core.query("stable_seed", "select skill_id, cast(cast('0x' || substr(sha256('42:' || skill_id), 1, 16) as ubigint) as varchar) as seed from skill_corpus")
def stable_seed(spark: SparkSession, d: str) -> DataFrame:
    """B12."""
    return table(spark, d, "skill_corpus").select("skill_id", S.stable_seed(42, F.col("skill_id")).alias("seed"))


@core.query(
    "query_fingerprint",
    "select dataset, sha256(string_agg(instance_id || chr(9) || coalesce(question, ''), chr(10) order by instance_id || chr(9) || coalesce(question, ''))) as fingerprint from bench_instance group by dataset",
)
def query_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """B13 of the test items of each dataset."""
    t = table(spark, d, "bench_instance").select("dataset", F.concat_ws("\t", "instance_id", F.coalesce("question", F.lit(""))).alias("x"))
    return t.groupBy("dataset").agg(S.fingerprint(F.collect_list("x")).alias("fingerprint"))


@core.query(
    "strip_think",
    r"""with r as (select distinct record_id, '<think>' || coalesce(model, '') || '</think>  ' || raw_output || '<think>' || coalesce(method, '') as t from inference_record where raw_output is not null)
    select record_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>\s*', '', 'g'), '(?s)<think>.*$', ''), '^\s+', '') as text from r""",
)
def strip_think(spark: SparkSession, d: str) -> DataFrame:
    """B14 on replies put between think blocks."""
    t = table(spark, d, "inference_record").where("raw_output is not null")
    wrapped = F.concat(F.lit("<think>"), F.coalesce("model", F.lit("")), F.lit("</think>  "), "raw_output", F.lit("<think>"), F.coalesce("method", F.lit("")))
    return t.select("record_id", wrapped.alias("t")).distinct().select("record_id", S.strip_think(F.col("t")).alias("text"))


@core.query(
    "labels_and_cuts",
    r"""with r as (select distinct record_id, model, method, raw_output from inference_record)
    select record_id, case when length(raw_output) > 200 then substr(raw_output, 1, 200) || '...' else raw_output end as cut,
      split_part('org/' || model, '/', -1) as short_name,
      split_part('org/' || model, '/', -1) || case when trim(method) like 'hybrid%' then '_rerank' else '' end as label from r""",
)
def labels_and_cuts(spark: SparkSession, d: str) -> DataFrame:
    """B9, B18, B29."""
    t = table(spark, d, "inference_record").select("record_id", "model", "method", "raw_output").distinct()
    model = F.concat(F.lit("org/"), "model")
    return t.select(
        "record_id",
        S.truncate(F.col("raw_output"), 200, "...").alias("cut"),
        S.model_short_name(model).alias("short_name"),
        S.retrieval_label(model, F.when(F.trim("method").startswith("hybrid"), F.col("method"))).alias("label"),
    )


@core.query(
    "scope_labels",
    """with s as (select dataset, list_sort(list(skill_id)) as ids from (select regexp_replace(skill_id, '_[^_]*$', '') as dataset, skill_id from skill_corpus) group by dataset)
    select dataset, case when len(ids) = 1 then ids[1] else 'skills-' || substr(sha256(array_to_string(ids, chr(10))), 1, 12) end as label from s""",
)
def scope_labels(spark: SparkSession, d: str) -> DataFrame:
    """B30 of the skills of each dataset."""
    t = table(spark, d, "skill_corpus").select(S.dataset_of(F.col("skill_id")).alias("dataset"), "skill_id")
    return t.groupBy("dataset").agg(F.collect_list("skill_id").alias("ids")).select("dataset", S.scope_label(F.col("ids")).alias("label"))


@core.query(
    "number_signature",
    f"""with t as (select distinct instance_id, question from synthetic_task where question is not null)
    select instance_id, array_to_string(regexp_extract_all({norm('question')}, '[0-9]+(?:\\.[0-9]+)?'), ' ') as signature from t""",
)
def number_signature(spark: SparkSession, d: str) -> DataFrame:
    """B23."""
    t = table(spark, d, "synthetic_task").where("question is not null").select("instance_id", "question").distinct()
    return t.select("instance_id", F.array_join(S.number_signature(F.col("question")), " ").alias("signature"))


@core.query(
    "keywords",
    rf"""select doc_id, coalesce(list_filter(regexp_extract_all(regexp_replace(regexp_replace(substr(text, 1, 400), '\p{{M}}', '.', 'g'), '[ªµºÀ-ÖØ-öø-ˁͰ-ͽͿ-҂Ҋ-\x{{1FFF}}\x{{2C00}}-\x{{2DFF}}\x{{3040}}-\x{{D7FF}}\x{{FF10}}-\x{{FFDC}}]', '_', 'g'), '{S.PHRASE}'),
      lambda p: length(p) >= 4 and lower(regexp_extract(p, '^[^ \t\r\n\f]+')) not in ({', '.join(f"'{s}'" for s in STOP)}))[1], '{S.NO_KEYWORD}') as keyword from documents""",
)
def keywords(spark: SparkSession, d: str) -> DataFrame:
    """B24 of every document."""
    return table(spark, d, "documents").select("doc_id", S.keyword(F.col("text"), STOP).alias("keyword"))


@core.query(
    "actions",
    r"""with r as (select distinct record_id, raw_output from inference_record where raw_output is not null),
    a as (select record_id, unnest(regexp_extract_all(raw_output, '(?m)^Action \d+: (.+)$', 1)) as a from r)
    select record_id, a as action, case when regexp_matches(trim(a), '(?s)^(\w+)\[(.+)\]$') then regexp_extract(trim(a), '(?s)^(\w+)\[(.+)\]$', 1) end as kind,
      case when regexp_matches(trim(a), '(?s)^(\w+)\[(.+)\]$') then regexp_extract(trim(a), '(?s)^(\w+)\[(.+)\]$', 2) end as argument from a""",
)
def actions(spark: SparkSession, d: str) -> DataFrame:
    """B19 on the action lines of all replies."""
    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "raw_output").distinct()
    a = r.select("record_id", F.explode(F.regexp_extract_all("raw_output", F.lit(r"(?m)^Action \d+: (.+)$"), F.lit(1))).alias("action"))
    return a.select("record_id", "action", S.parse_action(F.col("action")).alias("p")).select("record_id", "action", "p.kind", "p.argument")


@core.query(
    "tool_mentions",
    r"""with r as (select distinct record_id, raw_output from inference_record where raw_output is not null),
    m as (select record_id, regexp_extract_all(raw_output, '\b[A-Z]\w+\[[^\[\]\n]+\]') as m from r),
    e as (select record_id, unnest(m) as call, generate_subscripts(m, 1) as pos from m)
    select record_id, split_part(call, '[', 1) as tool, min_by(call, pos) as first_call, count(*) as calls from e group by 1, 2""",
)
def tool_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first call of each tool, and how many calls."""
    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "raw_output").distinct()
    e = r.select("record_id", F.posexplode(F.regexp_extract_all("raw_output", F.lit(r"\b[A-Z]\w+\[[^\[\]\n]+\]"), F.lit(0))).alias("pos", "call"))
    return e.groupBy("record_id", F.substring_index("call", "[", 1).alias("tool")).agg(F.min_by("call", "pos").alias("first_call"), F.count(F.lit(1)).alias("calls"))


@core.query(
    "rankings_parsed",
    r"""with r as (select distinct record_id, raw_output from inference_record where raw_output is not null),
    p as (select record_id, list_filter(list_transform(regexp_extract_all(raw_output, '\d{1,9}'), lambda x: cast(x as integer)), lambda x: x between 1 and 20) as l from r)
    select record_id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x - 1), ',') as ranking, l[1] - 1 as first_pick from p""",
)
def rankings_parsed(spark: SparkSession, d: str) -> DataFrame:
    """B22 with twenty candidates."""
    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "raw_output").distinct()
    p = r.select("record_id", S.parse_ranking(F.col("raw_output"), 20).alias("l"))
    return p.select("record_id", F.array_join("l", ",").alias("ranking"), F.get("l", F.lit(0)).alias("first_pick"))


@core.query(
    "flattened_lists",
    """with t as (select distinct instance_id, array_to_string(gold_skill_ids, ' , ') || ',,' || array_to_string(datasets, ',') as x from synthetic_task),
    l as (select instance_id, list_filter(list_transform(string_split(x, ','), lambda e: trim(e)), lambda e: e <> '') as l from t where x is not null)
    select instance_id, array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i), '|') as items from l""",
)
def flattened_lists(spark: SparkSession, d: str) -> DataFrame:
    """B32."""
    x = F.concat(F.array_join("gold_skill_ids", " , "), F.lit(",,"), F.array_join("datasets", ","))
    t = table(spark, d, "synthetic_task").select("instance_id", x.alias("x")).where("x is not null").distinct()
    return t.select("instance_id", F.array_join(S.flatten_list(F.array("x")), "|").alias("items"))


@core.query("json_in_prose")
def json_in_prose(spark: SparkSession, d: str) -> DataFrame:
    """A28 over the crawl: documents that hold a JSON value."""
    t = table(spark, d, "documents").where(F.col("text").rlike(r"[{\[]"))
    return t.select("doc_id", S.json_from_prose("text").alias("json")).where("json is not null")


@core.query("react_steps")
def react_steps(spark: SparkSession, d: str) -> DataFrame:
    """B21 on all replies."""
    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "raw_output").distinct()

    def run(batches):
        for pdf in batches:
            steps = [S.react_step(t, 1) for t in pdf["raw_output"]]
            yield pdf[["record_id"]].assign(thought=[s[0] for s in steps], action=[s[1] for s in steps])

    return r.mapInPandas(run, "record_id bigint, thought string, action string")


@core.query("tool_calls")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """A call of a skill's first tool, written into text and parsed back."""
    tools = table(spark, d, "skill_corpus").where(F.size(F.coalesce("tools", F.array())) > 0)
    first = F.element_at("tools", 1)
    t = tools.select("skill_id", first["name"].alias("name"), F.sort_array(F.map_keys(first["parameters"])).alias("params"), F.concat(F.lit("Let me see.\nTOOL_CALL: "), first["name"], F.lit('(1, "x")\n')).alias("text"))

    def run(batches):
        for pdf in batches:
            yield pdf[["skill_id"]].assign(call=[S.tool_call_of(t, {n: list(p)}) for t, n, p in zip(pdf["text"], pdf["name"], pdf["params"])])

    return t.mapInPandas(run, "skill_id string, call string")
