"""Queries of answer extraction and scoring (survey section C and parts of F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.operators import scoring as G
from quillmill.plans.registry import core
from quillmill.session import table

R = """r as (select distinct i.record_id, i.method, i.model, regexp_replace(regexp_replace(regexp_replace(case when i.meta.failed then '' else coalesce(i.raw_output, '') end, '(?s)<think>.*?</think>\\s*', '', 'g'), '(?s)<think>.*$', ''), '^\\s+', '') as x,
      e.dataset, e.question, e.eval_data as d from inference_record i join example_instance e using (instance_id))"""


def s(x: str) -> str:
    """strip in SQL."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def trig(x: str) -> str:
    """after_trigger in SQL."""
    p = f"'(?s)^.*{A.TRIGGERS}(.*)$'"
    line = s(f"split_part(regexp_extract({x}, {p}, 1), chr(10), 1)")
    cleaned = s(f"regexp_replace(regexp_replace({line}, '\\.+$', ''), '/+$', '')")
    return f"case when regexp_matches({x}, {p}) then {cleaned} end"


def last_line(x: str) -> str:
    """last_line in SQL."""
    strip = s("l")
    return f"coalesce(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip}), lambda l: l <> '')[-1], '')"


def num(x: str) -> str:
    """number in SQL."""
    f, n = A.FRACTION, A.NUMBER
    value = (
        f"coalesce(case when regexp_matches({x}, '{n}') then try_cast(trim({x}) as double) end, "
        f"case when regexp_matches({x}, '{f}') then try_cast(regexp_extract({x}, '{f}', 1) as double) / nullif(try_cast(regexp_extract({x}, '{f}', 2) as double), 0) end)"
    )
    return f"(case when abs({value}) < 'inf'::double then {value} end)"


FINISH = r"list_extract(regexp_extract_all(x, 'Finish\[([^\]]*)\]', 1), -1)"
TOOLQA_X = f"coalesce({s(FINISH)}, {trig('x')}, {last_line('x')})"


def tnorm(x: str) -> str:
    """toolqa_normalize in SQL."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '{A.PUNCTUATION}', '', 'g'), '\\b(a|an|the|usd)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def tmatch(x: str, g: str) -> str:
    """toolqa_match in SQL."""
    return f"""case when {tnorm(x)} = {tnorm(g)} then 'exact' when regexp_matches({x}, '{A.NUMBER}') and regexp_matches({g}, '{A.NUMBER}') and abs({num(x)} - {num(g)}) < 1e-6 then 'numeric'
      when case lower({x}) when 'true' then 'yes' when 'false' then 'no' end = {s(f'lower({g})')} then 'boolean' else 'none' end"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Replies joined with their examples; delivered-again rows once, failed runs with an empty reply."""
    i = table(spark, d, "inference_record").select("record_id", "instance_id", "method", "model", "raw_output", "error", F.col("meta.failed").alias("failed")).distinct()
    e = table(spark, d, "example_instance").select("instance_id", "dataset", "question", "eval_data")
    return i.join(e, "instance_id").withColumn("raw_output", F.when(F.coalesce("failed", F.lit(False)), F.lit("")).otherwise(F.coalesce("raw_output", F.lit(""))))


@core.query("eval_toolqa", f"with {R}, t as (select record_id, {TOOLQA_X} as a, {s(chr(39) * 2 + ' || d.answer')} as g from r where dataset = 'toolqa') select record_id, a as extracted_answer, {tmatch('a', 'g')} as match_type, {tmatch('a', 'g')} <> 'none' as correct from t")
def eval_toolqa(spark: SparkSession, d: str) -> DataFrame:
    """C9, C10."""
    return G.native_details(_results(spark, d).where("dataset = 'toolqa'"), "raw_output", "dataset", "question", "eval_data").select("record_id", "extracted_answer", "match_type", "correct")


NEG = "|".join(A.NEGATIONS)
BQA = f"""b0 as (select *, {s('x')} as t from r where dataset = 'logicbench' and coalesce(d.task_type, 'BQA') = 'BQA'),
    b as (select *, lower(t) as l, right(lower(t), 500) as tail from b0),
    bx as (select *, coalesce(case when list_extract(regexp_extract_all(l, '(?:the\\s+)?answer\\s+is[:\\s]*\\**\\s*(yes|no|true|false)\\b', 1), -1) in ('yes', 'true') then 'yes'
        when list_extract(regexp_extract_all(l, '(?:the\\s+)?answer\\s+is[:\\s]*\\**\\s*(yes|no|true|false)\\b', 1), -1) is not null then 'no' end,
      case when regexp_matches(l, '^\\**(yes|no)\\**[.,!\\s]') then regexp_extract(l, '^\\**(yes|no)\\**[.,!\\s]', 1) end,
      case when regexp_matches(tail, '{NEG}') then 'no' end, list_extract(regexp_extract_all(tail, '\\b(yes|no)\\b', 1), -1),
      case when contains(tail, 'true') then 'yes' when contains(tail, 'false') then 'no' end, lower({s("list_extract(string_split(t, chr(10)), -1)")})) as a from b)"""


@core.query("eval_logic_bqa", f"with {R}, {BQA} select record_id, a as extracted_answer, {s('lower(a)')} = lower({s('d.answer')}) as correct from bx")
def eval_logic_bqa(spark: SparkSession, d: str) -> DataFrame:
    """C3, C5."""
    r = _results(spark, d).where("dataset = 'logicbench' and coalesce(eval_data.task_type, 'BQA') = 'BQA'")
    return G.native_details(r, "raw_output", "dataset", "question", "eval_data").select("record_id", "extracted_answer", "correct")


def _choice(i: int) -> str:
    p = f"(?i)choice_{i}:\\s*(.+?)(?:\\n|choice_|$)"
    own = s(f"regexp_extract(coalesce(question, ''), '{p}', 1)")
    return f"case when regexp_matches(coalesce(question, ''), '{p}') and contains(tail, substr(lower({own}), 1, 40)) then 'choice_{i}' end"


MCQA = f"""m0 as (select *, {s('x')} as t from r where dataset = 'logicbench' and d.task_type = 'MCQA'),
    m1 as (select *, lower(t) as l, right(lower(t), 500) as tail from m0), m2 as (select *, {s(f"lower(coalesce({trig('t')}, {last_line('t')}))")} as ans from m1),
    mx as (select *, coalesce('choice_' || list_extract(regexp_extract_all(l, 'choice[_ ]?(\\d+)', 1), -1),
      case when regexp_matches(l, '(?:answer|option)\\s*(?:is)?[:\\s]*\\**\\s*(?:choice[_ ]?)?(\\d+)\\b') then 'choice_' || regexp_extract(l, '(?:answer|option)\\s*(?:is)?[:\\s]*\\**\\s*(?:choice[_ ]?)?(\\d+)\\b', 1) end,
      {', '.join(_choice(i) for i in range(5, 0, -1))}, case when regexp_matches(ans, '\\b([1-5])\\b') then 'choice_' || regexp_extract(ans, '\\b([1-5])\\b', 1) end, ans) as a from m2)"""


@core.query("eval_logic_mcqa", f"with {R}, {MCQA} select record_id, a as extracted_answer, {s('lower(a)')} = lower({s('d.answer')}) as correct from mx")
def eval_logic_mcqa(spark: SparkSession, d: str) -> DataFrame:
    """C4, C5."""
    r = _results(spark, d).where("dataset = 'logicbench' and eval_data.task_type = 'MCQA'")
    return G.native_details(r, "raw_output", "dataset", "question", "eval_data").select("record_id", "extracted_answer", "correct")


IDS = ", ".join(map(str, A.INTEGER_IDS))
DATE_RE = "(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/([0-9]{4})"
WK = A.WEEKS.replace("'", "''")


def day(x: str) -> str:
    """A date in month/day/year in SQL."""
    return f"case when regexp_matches({s(x)}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') then try_strptime({s(x)}, '%m/%d/%Y') end"


def weeks(x: str) -> str:
    """Weeks and days as one number in SQL."""
    return f"case when regexp_matches({x}, '{WK}') then cast(regexp_extract({x}, '{WK}', 1) as bigint) * 100 + cast(regexp_extract({x}, '{WK}', 2) as bigint) end"


_LINE = s("substr(list_filter(list_transform(string_split(x, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: starts_with(upper(l), 'ANSWER:'))[-1], 8)")
_FIELD = f"regexp_replace(regexp_replace({s('regexp_extract(x, %s, 1)' % repr('[Aa]nswer' + chr(34) + ':' + chr(92) + 's*(.*?)' + chr(92) + '}'))}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"
MEDCALC = f"""c0 as (select *, {s(f"regexp_replace({_LINE}, '^[*]+|[*]+$', '', 'g')")} as line, {_FIELD} as field, {s("'' || d.answer")} as g from r where dataset = 'medcalcbench'),
    c as (select *, coalesce(line, case when field not in ('', 'X.XX') then field end, {trig('x')},
      case when (coalesce(d.output_type = 'date', false) or coalesce(d.calculator_id in (13, 68), false)) and regexp_matches(x, '{DATE_RE}')
        then lpad(regexp_extract(x, '{DATE_RE}', 1), 2, '0') || '/' || lpad(regexp_extract(x, '{DATE_RE}', 2), 2, '0') || '/' || regexp_extract(x, '{DATE_RE}', 3) end,
      case when d.calculator_id = 69 and regexp_matches(x, '{WK}') then '(' || regexp_extract(x, '{WK}', 1) || ', ' || regexp_extract(x, '{WK}', 2) || ')' end,
      list_extract(regexp_extract_all(x, '-?[0-9]+\\.?[0-9]*'), -1), {last_line('x')}) as a from c0)"""


@core.query(
    "eval_medcalc",
    f"""with {R}, {MEDCALC} select record_id, a as extracted_answer, coalesce(case when d.calculator_id in (13, 68) then {day('a')} = {day('g')} when d.calculator_id = 69 then {weeks('a')} = {weeks('g')}
      when coalesce(d.calculator_id in ({IDS}), false) or coalesce(d.output_type = 'integer', false) then round_even({num('a')}, 0) = round_even({num('g')}, 0)
      else {num('a')} between {num('d.lower_limit')} and {num('d.upper_limit')} end, false) as correct from c""",
)
def eval_medcalc(spark: SparkSession, d: str) -> DataFrame:
    """C6 to C8."""
    r = _results(spark, d).where("dataset = 'medcalcbench'")
    return G.native_details(r, "raw_output", "dataset", "question", "eval_data").select("record_id", "extracted_answer", "correct")


@core.query("eval_theorem")
def eval_theorem(spark: SparkSession, d: str) -> DataFrame:
    """C11 to C14: LaTeX and arithmetic answers, read by an evaluator of its own."""
    r = _results(spark, d).where("dataset = 'theoremqa'")
    return G.theorem_details(r, F.col("raw_output"), "eval_data").select("record_id", "extracted_answer", "correct")


@core.query("eval_details")
def eval_details(spark: SparkSession, d: str) -> DataFrame:
    """Every reply scored by the rules of its dataset."""
    return G.details(_results(spark, d), "raw_output", "dataset", "question", "eval_data").select("record_id", "dataset", "method", "extracted_answer", "match_type", "correct")


@core.query(
    "accuracy",
    f"""with {R}, t as (select record_id, method, dataset, {TOOLQA_X} as a, {s("'' || d.answer")} as g from r where dataset = 'toolqa'), {BQA}, {MCQA},
    u as (select method, dataset, {tmatch('a', 'g')} <> 'none' as ok from t union all select method, dataset, {s('lower(a)')} = lower({s('d.answer')}) from bx union all select method, dataset, {s('lower(a)')} = lower({s('d.answer')}) from mx)
    select method, dataset, cast(count(case when ok then 1 end) as bigint) as correct, count(*) as total, round(count(case when ok then 1 end) / count(*), 6) as accuracy from u group by 1, 2""",
)
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    """F3 by method, of the datasets that SQL can score too."""
    r = G.native_details(_results(spark, d).where("dataset in ('toolqa', 'logicbench')"), "raw_output", "dataset", "question", "eval_data")
    return G.accuracy(r, "method", "dataset").withColumn("accuracy", F.round("accuracy", 6))


@core.query("accuracy_all")
def accuracy_all(spark: SparkSession, d: str) -> DataFrame:
    """F3 by method, of all datasets; theoremqa needs Python, so there is no SQL."""
    r = G.details(_results(spark, d), "raw_output", "dataset", "question", "eval_data")
    return G.accuracy(r, "method", "dataset").withColumn("accuracy", F.round("accuracy", 6))


@core.query("val_accuracy")
def val_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Correct, whole and without error, by method and model."""
    r = G.details(_results(spark, d), "raw_output", "dataset", "question", "eval_data")
    ok = G.masked_correct(F.col("correct"), F.length("raw_output") > 1000, F.col("error"))
    return G.accuracy(r.withColumn("correct", ok), "method", "model")


@core.query(
    "compare_answer",
    f"""with r as (select distinct i.record_id, regexp_replace(coalesce(i.raw_output, ''), '^\\s+', '') as x, e.dataset, {s("coalesce(e.eval_data.answer, '')")} as g from inference_record i join example_instance e using (instance_id) where e.dataset = 'toolqa'),
    t as (select record_id, {TOOLQA_X} as a, g from r) select record_id, case when g = '' then false else {tmatch('a', 'g')} <> 'none' end as same from t""",
)
def compare_answer(spark: SparkSession, d: str) -> DataFrame:
    """C16, C17 on toolqa."""
    i = table(spark, d, "inference_record").select("record_id", "instance_id", "raw_output").distinct()
    e = table(spark, d, "example_instance").where("dataset = 'toolqa'")
    j = i.join(e, "instance_id")
    return j.select("record_id", G.compare_answer(F.col("raw_output"), F.col("eval_data.answer"), F.col("dataset"), F.col("question")).alias("same"))


@core.query("compare_medcalc")
def compare_medcalc(spark: SparkSession, d: str) -> DataFrame:
    """C16 on medcalcbench and logicbench, typed by the look of the truth."""
    i = table(spark, d, "inference_record").select("record_id", "instance_id", "raw_output").distinct()
    j = i.join(table(spark, d, "example_instance").where("dataset in ('medcalcbench', 'logicbench')"), "instance_id")
    return j.select("record_id", G.compare_answer(F.col("raw_output"), F.col("eval_data.answer"), F.col("dataset"), F.col("question")).alias("same"))


@core.query("compare_all")
def compare_all(spark: SparkSession, d: str) -> DataFrame:
    """C16 on every dataset, theoremqa included."""
    i = table(spark, d, "inference_record").select("record_id", "instance_id", "raw_output").distinct()
    j = i.join(table(spark, d, "example_instance"), "instance_id")
    return G.compared(j, "raw_output", F.col("eval_data.answer"), "dataset", "question").select("record_id", "same")


@core.query(
    "validate_eval_data",
    f"""with b as (select instance_id, dataset, question, eval_data as d, coalesce(eval_data.answer, '') as a, coalesce(eval_data.lower_limit, '') as lo, coalesce(eval_data.upper_limit, '') as up, coalesce(eval_data.answer_type, '') as t, coalesce(eval_data.task_type, '') as k,
      case when eval_data.calculator_id in (13, 68) then 'date' when eval_data.calculator_id = 69 then 'gestational_age' when eval_data.calculator_id in ({IDS}) then 'integer' else 'decimal' end as want from bench_instance
      union all select instance_id, dataset, question, eval_data, coalesce(eval_data.answer, ''), coalesce(eval_data.lower_limit, ''), coalesce(eval_data.upper_limit, ''), coalesce(eval_data.answer_type, ''), coalesce(eval_data.task_type, ''),
      case when eval_data.calculator_id in (13, 68) then 'date' when eval_data.calculator_id = 69 then 'gestational_age' when eval_data.calculator_id in ({IDS}) then 'integer' else 'decimal' end from example_instance),
    n as (select *, {num('a')} as n, {num('lo')} as nl, {num('up')} as nu from b)
    select instance_id, coalesce(case when trim(coalesce(question, '')) = '' then 'question' when dataset = 'theoremqa' then case when t not in ('float', 'integer', 'bool', 'option', 'list of integer', 'list of float') then 'answer_type'
        when a in ('', 'X.XX', 'PLACEHOLDER', '...') then 'placeholder' when t = 'float' and n is null and not starts_with(a, '[') then 'float' when t = 'integer' and (n is null or n <> floor(n)) then 'integer'
        when t = 'bool' and a not in ('True', 'False') then 'bool' when t = 'option' and not regexp_matches(a, '^\\([a-f]\\)$') then 'option' when starts_with(t, 'list') and not (starts_with(a, '[') and ends_with(a, ']')) then 'list' end
      when dataset = 'logicbench' then case when k not in ('BQA', 'MCQA') then 'task_type' when k = 'BQA' and a not in ('yes', 'no') then 'yes_no' when k = 'MCQA' and not regexp_matches(a, '^choice_[1-5]$') then 'choice'
        when k = 'MCQA' and coalesce(question, '') <> '' and len(list_distinct(regexp_extract_all(coalesce(question, ''), 'choice_[0-9]'))) < 2 then 'choices_in_question' end
      when dataset = 'medcalcbench' then case when d.calculator_id is null then 'calculator_id' when coalesce(d.output_type, '') <> want then 'output_type' when a in ('', 'X.XX', 'PLACEHOLDER') then 'placeholder' when lo = '' or up = '' then 'limits'
        when want <> 'decimal' and (lo <> a or up <> a) then 'limits_equal' when want = 'decimal' and (n is null or nl is null or nu is null) then 'limits_number'
        when want = 'decimal' and (abs(nl - n * 0.95) > greatest(abs(n * 0.95) * 0.01, 1e-6) or abs(nu - n * 1.05) > greatest(abs(n * 1.05) * 0.01, 1e-6)) then 'limits_range' end
      when dataset = 'toolqa' then case when a = '' then 'answer' end else 'dataset' end, '') as reason from n""",
)
def validate_eval_data(spark: SparkSession, d: str) -> DataFrame:
    """C20, C21 on test items and examples."""
    cols = ["instance_id", "dataset", "question", "eval_data"]
    rows = table(spark, d, "bench_instance").select(*cols).unionByName(table(spark, d, "example_instance").select(*cols))
    return rows.select("instance_id", A.eval_data_reason(F.col("dataset"), F.col("question"), "eval_data").alias("reason"))


@core.query(
    "format_only",
    f"""with r as (select distinct i.record_id, coalesce(i.raw_output, '') as x, e.dataset, coalesce(e.question, '') as q, coalesce(e.eval_data.answer, '') as a from inference_record i join example_instance e using (instance_id))
    select record_id, {s('x')} <> '' and {s('a')} <> '' and not (dataset = 'logicbench' and starts_with(a, 'choice_') and not contains(lower(q), 'choice_1')) as acceptable from r""",
)
def format_only(spark: SparkSession, d: str) -> DataFrame:
    """C25."""
    i = table(spark, d, "inference_record").select("record_id", "instance_id", "raw_output").distinct()
    j = i.join(table(spark, d, "example_instance"), "instance_id")
    return j.select("record_id", G.format_valid(F.col("raw_output"), F.col("eval_data.answer"), F.col("dataset"), F.col("question")).alias("acceptable"))


@core.query(
    "admission_reasons",
    """with r as (select distinct record_id, length(raw_output) > 900 as truncated, error is null as acceptable, raw_output, len(skill_ids_used) as samples from inference_record)
    select record_id, case when coalesce(truncated, false) then 'truncated' when not acceptable then 'not_acceptable' when not regexp_matches(coalesce(raw_output, ''), '[^\\s]') then 'no_answer' when coalesce(samples, 0) = 0 then 'no_samples' else '' end as reason from r""",
)
def admission_reasons(spark: SparkSession, d: str) -> DataFrame:
    """D4, D5, D10."""
    r = table(spark, d, "inference_record").select("record_id", (F.length("raw_output") > 900).alias("t"), F.col("error").isNull().alias("ok"), "raw_output", F.size("skill_ids_used").alias("n")).distinct()
    return r.select("record_id", G.admission_reason(F.col("t"), F.col("ok"), F.col("raw_output"), F.col("n")).alias("reason"))


@core.query(
    "calculator_aggs",
    """with l as (select l_orderkey, list(l_quantity order by l_linenumber) as q from lineitem group by 1)
    select l_orderkey, round(list_avg(q), 3) as mean, round(list_median(q), 3) as median, round(list_sum(q), 3) as sum, list_max(q) as max, list_min(q) as min from l""",
)
def calculator_aggs(spark: SparkSession, d: str) -> DataFrame:
    """The calculator's list functions on the quantities of each order, written as calls."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("l"))
    inner = F.array_join(F.transform("l", lambda x: x["l_quantity"].cast("string")), ", ")
    call = lambda f: A.calculate(F.concat(F.lit(f + "("), inner, F.lit(", nan)"))).alias(f)
    return l.select("l_orderkey", *(call(f) for f in ("mean", "median", "sum", "max", "min")))


@core.query("calculator_expressions")
def calculator_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic without eval."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("", F.lit("("), F.col("l_quantity").cast("string"), F.lit(" * 2 + sqrt("), F.col("l_linenumber").cast("string"), F.lit("))^2 / 4")).alias("expression"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(value=[A.calculate_text(x) for x in pdf["expression"]])

    return li.mapInPandas(run, "l_orderkey bigint, l_linenumber int, expression string, value string")


@core.query(
    "one_se",
    """with e as (select l_linenumber as epoch, avg(case when l_discount >= 0.05 then 1.0 else 0 end) as acc, count(*) as n from lineitem group by 1),
    b as (select epoch as best_epoch, acc as best, sqrt(acc * (1 - acc) / n) as se from e order by acc desc, epoch limit 1)
    select cast(best_epoch as bigint) as best_epoch, round(best, 6) as best, round(se, 6) as se, cast(min(epoch) as bigint) as chosen from e, b where acc >= best - se group by 1, 2, 3""",
)
def one_se(spark: SparkSession, d: str) -> DataFrame:
    """line numbers as epochs."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("epoch")).agg(F.avg(F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)).alias("acc"), F.count(F.lit(1)).alias("n"))
    return G.one_standard_error(e, "epoch", "acc", "n").select("best_epoch", F.round("best", 6).alias("best"), F.round("se", 6).alias("se"), "chosen")


@core.query("weighted_loss", "select l_returnflag, round(sum(l_extendedprice) / greatest(sum(l_quantity), 1), 6) as mean from lineitem group by 1")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """F26."""
    return G.weighted_mean(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag").select("l_returnflag", F.round("mean", 6).alias("mean"))


@core.query(
    "skill_calculators",
    "with t as (select skill_id, unnest(tools).name as tool from skill_corpus), c as (select tool, dense_rank() over (order by tool) % 7 as calculator_id from (select distinct tool from t)) select distinct skill_id, calculator_id from t join c using (tool)",
)
def skill_calculators(spark: SparkSession, d: str) -> DataFrame:
    """C19 with a catalog made of the corpus' own tools (a fixed library of a few hundred)."""
    from pyspark.sql import Window

    s = table(spark, d, "skill_corpus")
    tools = s.select(F.explode("tools.name").alias("tool")).distinct()
    catalog = tools.select("tool", F.pmod(F.dense_rank().over(Window.orderBy("tool")), F.lit(7)).cast("bigint").alias("calculator_id"))
    return G.calculators_of(s, catalog)


@core.query(
    "tool_availability",
    "select skill_id, case when starts_with(skill_id, 'medcalcbench') then cast(len(coalesce(tools, [])) as bigint) else 0 end as tools from skill_corpus",
)
def tool_availability(spark: SparkSession, d: str) -> DataFrame:
    """D16."""
    n = F.size(F.coalesce("tools", F.array())).cast("bigint")
    return table(spark, d, "skill_corpus").select("skill_id", F.when(F.col("skill_id").startswith("medcalcbench"), n).otherwise(F.lit(0).cast("bigint")).alias("tools"))


@core.query("best_model", "with r as (select distinct record_id, instance_id, model, length(raw_output) as n from inference_record where raw_output is not null) select instance_id, record_id, n from r qualify row_number() over (partition by instance_id order by n desc, record_id) = 1")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    """the longest reply of each example, the earlier among equals."""
    r = table(spark, d, "inference_record").where("raw_output is not null").select("record_id", "instance_id", F.length("raw_output").alias("n")).distinct()
    return G.best_of(r, "instance_id", "n", "record_id").select("instance_id", "record_id", F.col("n").cast("bigint").alias("n"))
