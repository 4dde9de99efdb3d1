"""The queries as SQL over the given tables, written apart from the Spark code to check it."""

from __future__ import annotations

from stillhouse import fixed
from stillhouse.functions.answers import ANNOTATION, ANNOTATION_PARTS
from stillhouse.functions.text import SPACE, SPACE_CHARS
from stillhouse.operators.profile import BOLD, HEADING, LATEX
from stillhouse.plans.queries import OUTPUT, SMALL_ROWS
from stillhouse.sources.stats import STATS_KEYS


def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


N, M = fixed.NUMBER, fixed.PLAIN_NUMBER
_NUMERIC = (
    r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
)
WS = _str(SPACE_CHARS)


def _round(value: str, digits: int) -> str:
    return f"cast(printf('%.{digits}f', cast({value} as double)) as double)"


# --- tables derived from the given ones ------------------------------------------------------

_WORKED = (
    "concat('The total is ', q, '*', u, '=<<', q, '*', u, '=', q * u, '>>', q * u, ' {unit}.', "
    "chr(10), '#### ', format('{{:,}}', q * u))"
)

CTES = {
    "train": f"""
        select idx, 'train' as split,
          concat('An order has ', q, ' items at ', u, ' dollars each. What is the total?') as question,
          {_WORKED.format(unit="dollars")} as answer
        from (select o_orderkey as idx, 1 + o_orderkey % 50 as q, 1 + o_custkey % 97 as u from orders)""",
    "test": f"""
        select idx, 'test' as split,
          concat('A user logs ', q, ' events of kind ', kind, ' worth ', u,
                 ' points each. How many points is that?') as question,
          {_WORKED.format(unit="points")} as answer
        from (select event_id as idx, event_type as kind,
                1 + event_id % 50 as q, 1 + user_id % 97 as u from events)""",
    "problems": "select * from train union all select * from test",
    "predictions": """
        select teacher, idx,
          case idx % 5 when 0 then concat('Work shown.', chr(10), '#### ', format('{:,}', g))
            when 1 then concat('So the answer is ', g, '.')
            when 2 then concat('total = ', g, chr(10))
            when 3 then concat('It comes to ', g, ' dollars')
            else concat('#### $', g, '.00') end as response
        from (select teacher, event_id as idx,
                (1 + event_id % 50) * (1 + user_id % 97)
                + case when ((event_id // 7) * k) % m = 0 then 1 else 0 end as g
              from events, (values ('base', 3, 4), ('gpt', 2, 10), ('deepseek', 5, 8),
                                   ('gemini', 7, 6), ('original', 1, 2)) v(teacher, k, m))""",
    "attempts": """
        select teacher, idx, attempt, attempt = fails as ok,
          case when attempt = fails then null
               when idx % 3 = 0 then 'HTTP 429 Too Many Requests'
               when idx % 3 = 1 then 'Quota exceeded' else 'connection reset' end as error,
          case when attempt = fails then concat('Step 1: multiply.', chr(10), answer) end as completion,
          idx * sec + attempt as at_s
        from (select teacher, sec, idx, answer,
                case when teacher = 'deepseek' and idx between 700 and 730 then 5
                     when (idx * k) % m < c then 5
                     when (idx * k) % 11 = 0 then 2 else 0 end as fails
              from train, (values ('gpt', 3, 29, 1, 8), ('deepseek', 5, 31, 1, 9),
                                  ('gemini', 7, 5, 3, 5)) v(teacher, k, m, c, sec)) a,
             (values (0), (1), (2), (3), (4)) w(attempt)
        where attempt <= fails""",
    # the last attempt of each request, found by comparing attempts and not by the retry rule
    "outcomes": """
        select teacher, idx, max_by(ok, attempt) as ok, max_by(coalesce(error, ''), attempt) as error,
          max_by(coalesce(completion, ''), attempt) as completion, max_by(at_s, attempt) as at_s
        from attempts group by teacher, idx""",
    "completions": """
        select idx, question, p.answer,
          case when ok then completion else concat('ERROR: ', error) end as synthetic_answer, teacher
        from outcomes join train p using (idx)""",
    "totals": "select count(*) as total from train",
}

_NEEDS = {
    "problems": ["train", "test"],
    "attempts": ["train"],
    "outcomes": ["attempts"],
    "completions": ["outcomes", "train"],
    "totals": ["train"],
}


def _with(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause of the named tables and what they are made from."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({CTES[n]})" for n in order]
    parts += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n"


# --- answers ---------------------------------------------------------------------------------


def _rules(text: str) -> list[str]:
    return [
        f"nullif(regexp_extract({text}, '####{SPACE}*({N})', 1), '')",
        f"nullif(regexp_extract(lower({text}), '(?:answer is|answer:){SPACE}*({N})', 1), '')",
        f"nullif(regexp_extract({text}, '[=:]{SPACE}*({N}){SPACE}*$', 1), '')",
        f"regexp_extract_all({text}, '{N}')[-1]",
    ]


def _extract(text: str) -> str:
    return f"replace(coalesce({', '.join(_rules(text))}, ''), ',', '')"


def _rule(text: str) -> str:
    whens = " ".join(f"when {r} is not null then {i}" for i, r in enumerate(_rules(text), 1))
    return f"case {whens} else 0 end"


def _short(text: str) -> str:
    tail = f"regexp_extract_all(string_split({text}, '####')[-1], '{M}')[1]"
    found = [
        f"case when contains({text}, '####') then {tail} end",
        f"nullif(regexp_extract({text}, '[Tt]he answer is{SPACE}*({M})', 1), '')",
        f"nullif(regexp_extract({text}, '[Aa]nswer:{SPACE}*({M})', 1), '')",
        f"nullif(regexp_extract({text}, '={SPACE}*({M}){SPACE}*$', 1), '')",
        f"nullif(regexp_extract({text}, '({M}){SPACE}*$', 1), '')",
        f"regexp_extract_all({text}, '{M}')[-1]",
    ]
    return f"coalesce({', '.join(found)})"


def _truth(answer: str) -> str:
    return f"trim(string_split({answer}, '####')[-1], {WS})"


def _bare(answer: str) -> str:
    return f"trim(replace(coalesce({answer}, ''), ',', ''), {WS})"


def _value(answer: str) -> str:
    b = _bare(answer)
    return (
        f"case when regexp_matches({b}, '{_NUMERIC}') then try_cast(replace({b}, '_', '') as double) end"
    )


def _normal(answer: str) -> str:
    b = _bare(answer)
    tidy = f"regexp_replace({b}, '^(-?)0+(\\d)', '\\1\\2')"
    tidy = f"regexp_replace({tidy}, '(\\.\\d*[1-9])0+$', '\\1')"
    tidy = f"regexp_replace({tidy}, '\\.0*$', '')"
    tidy = f"regexp_replace({tidy}, '^-0$', '0')"
    return f"case when regexp_matches({b}, '^-?\\d+\\.?\\d*$') then {tidy} else {b} end"


_SAME = (
    "coalesce(case when pv is null and tv is null then pb = tb else pv = tv end, false)"
)

GRADED = f"""
    select teacher, idx, ground_truth, predicted, rule, {_SAME} as correct
    from (select p.teacher, idx, predicted, rule, {_bare("predicted")} as pb, {_value("predicted")} as pv
          from (select teacher, idx, {_extract("response")} as predicted, {_rule("response")} as rule
                from predictions) p) a
    join (select idx, ground_truth, {_bare("ground_truth")} as tb, {_value("ground_truth")} as tv
          from (select idx, {_truth("answer")} as ground_truth from test) t) b using (idx)"""

GRADED_SHORT = f"""
    select teacher, idx, {_SAME} as correct
    from (select teacher, idx, {_bare("predicted")} as pb, {_value("predicted")} as pv
          from (select teacher, idx, {_short(f"trim(response, {WS})")} as predicted from predictions) p) a
    join (select idx, {_bare("truth")} as tb, {_value("truth")} as tv
          from (select idx, {_short(f"trim(answer, {WS})")} as truth from test) t) b using (idx)"""

ACCURACY = f"""
    select 'test' as split, teacher, count(*) filter (where correct) as correct, count(*) as total,
      {_round("count(*) filter (where correct) / count(*)", 4)} as accuracy
    from {{graded}} group by teacher"""

LABEL = "case when teacher = 'base' then 'BASE (no fine-tuning)' else upper(teacher) end"


def _graded(**extra: str) -> str:
    return _with("test", "predictions", extra={"graded": GRADED, **extra})


def _accuracy(**extra: str) -> str:
    return _graded(accuracy=ACCURACY.format(graded="graded"), **extra)


# --- chat --------------------------------------------------------------------------------------

_INSTRUCTION = _str(fixed.INSTRUCTION)


def _turn(role: str, content: str) -> str:
    return f"'<|im_start|>', {role}, chr(10), {content}, '<|im_end|>', chr(10)"


_USER = f"concat({_INSTRUCTION}, chr(10), chr(10), question)"
_PAIRS = """
    select teacher, idx, question, synthetic_answer as target from completions
    where not starts_with(synthetic_answer, 'ERROR:')
    union all select 'original', idx, question, answer from train"""

# --- the log of calls --------------------------------------------------------------------------

_MODEL = (
    "case teacher when 'gpt' then 'gpt-4o-mini' when 'deepseek' then 'deepseek-chat' "
    "when 'gemini' then 'gemini-2.0-flash' end"
)
STATS = f"""
    select teacher, {_MODEL} as model, total, processed, errors, processed - errors as successful,
      100.0::double * (processed - errors) / total as success_rate,
      minutes, processed / minutes as rows_per_min
    from (select teacher, count(*) as processed, count(*) filter (where not ok) as errors
          from outcomes group by teacher)
    join (select teacher, (max(at_s) - min(at_s)) / 60.0::double as minutes
          from attempts group by teacher) using (teacher), totals"""

_STATS_VALUES = (
    "upper(teacher)",
    "cast(total as varchar)",
    "cast(successful as varchar)",
    "cast(errors as varchar)",
    "printf('%.2f%%', success_rate)",
    "printf('%.1f minutes', minutes)",
    f"concat('{OUTPUT}/teacher=', teacher)",
)

BLOCKS = """
    select teacher, idx // 100 as block, count(*) as rows, count(*) filter (where not ok) as errors
    from outcomes group by teacher, idx // 100 having count(*) = 100"""

# position of the last good row before each failure, over the whole log in one window
RUNS = """
    select teacher, min(idx) as first_idx, max(idx) as last_idx, count(*) as run_rows
    from (select teacher, idx, ok, max(case when ok then idx end)
            over (partition by teacher order by idx) as last_ok from outcomes)
    where not ok group by teacher, last_ok"""

TRIPS = """
    select teacher, trip_idx, cut_idx, stop_reason from (
      select *, row_number() over (partition by teacher order by trip_idx, cut_idx) as n from (
        select teacher, first_idx + 9 as trip_idx, first_idx + 9 as cut_idx,
          'consecutive' as stop_reason from runs where run_rows >= 10
        union all
        select teacher, block * 100 + 99, block * 100 + 100, 'error_rate'
        from blocks where errors / 100.0 > 0.5)) where n = 1"""


def _breaker() -> str:
    return _with(
        "outcomes", "totals", extra={"runs": RUNS, "blocks": BLOCKS, "trips": TRIPS}
    )


_REPORT = """
    select teacher, any_value(total) as total,
      count(*) filter (where trip_idx is null or idx <= trip_idx) as processed,
      count(*) filter (where cut_idx is null or idx < cut_idx) as kept,
      count(*) filter (where not ok and (trip_idx is null or idx <= trip_idx)) as errors,
      count(*) filter (where ok and (trip_idx is null or idx <= trip_idx)) as successful,
      any_value(total) - count(*) filter (where not ok and (trip_idx is null or idx <= trip_idx))
        as reported_successful,
      max(cut_idx) as cut_idx, coalesce(max(stop_reason), 'finished') as stop_reason
    from outcomes left join trips using (teacher), totals group by teacher"""

_SAMPLED = f"""
    select * from (select *, row_number() over (order by md5(concat('{fixed.SEED}:', idx)), idx) as n
                   from {{table}}) where n <= {{rows}}"""

RUN_FACTS = """
    select teacher, count(*) as train_size, 16::bigint as effective_batch_size,
      2 * cast(ceil(count(*) / 16.0) as bigint) as total_steps
    from pairs group by teacher"""

_BACKOFF = """
    case when attempt < 4 then 2.0::double * power(
      case when contains(lower(error), '429') or contains(lower(error), 'rate limit')
             or contains(lower(error), 'quota') then 3.0::double else 2.0::double end, attempt) end"""


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _profile(text: str, by: str, table: str) -> str:
    return f"""
    select {by}, count(*) as texts,
      {_round(f"sum(length({text})) / count(*)", 2)} as avg_chars,
      max(length({text})) as max_chars,
      {_round(f"sum(len(string_split({text}, chr(10)))) / count(*)", 2)} as avg_lines,
      cast(sum({_count(text, LATEX)}) as bigint) as latex,
      cast(sum({_count(text, HEADING)}) as bigint) as headings,
      cast(sum({_count(text, BOLD)}) as bigint) as bold,
      cast(sum({_count(text, ANNOTATION)}) as bigint) as annotations
    from {table} group by {by}"""


ORACLE: dict[str, str] = {
    "leaderboard_lift": _accuracy()
    + f"""
    select a.*, b.accuracy as base_accuracy, {_round("a.accuracy - b.accuracy", 4)} as lift,
      {_round("(a.accuracy - b.accuracy) * 100", 2)} as lift_points,
      printf('%+.2f%%', (a.accuracy - b.accuracy) * 100) as lift_text,
      {_round("a.correct / a.total - b.correct / b.total", 6)} as lift_exact,
      case when a.accuracy >= b.accuracy then 'improvement' else 'degradation' end as direction,
      {_round("(a.accuracy - b.accuracy) / b.accuracy", 4)} as relative_gain,
      rank() over (order by a.accuracy desc) as place,
      {LABEL.replace("teacher", "a.teacher")} as label
    from accuracy a join accuracy b on b.teacher = 'base' and a.split = b.split""",
    "graded_rows": _graded() + f"select *, {_normal('predicted')} as normalized from graded",
    "extract_answer_documents": f"""
    select doc_id, {_rule("text")} as rule, {_extract("text")} as answer from documents""",
    "extract_notebook_variant": _with("predictions")
    + f"select teacher, idx, {_short(f'trim(response, {WS})')} as answer from predictions",
    "ground_truth": _with("problems")
    + f"select split, idx, {_truth('answer')} as ground_truth from problems",
    "normalize_answers": _with("predictions")
    + f"""
    select teacher, idx, answer, {_normal("answer")} as normalized
    from (select teacher, idx, {_extract("response")} as answer from predictions)""",
    "accuracy_by_teacher": _accuracy() + "select * from accuracy where teacher <> 'base'",
    "accuracy_notebook_variant": _with(
        "test", "predictions", extra={"graded": GRADED_SHORT}
    )
    + ACCURACY.format(graded="graded"),
    "running_accuracy": _graded()
    + """
    select teacher, idx, correct, correct_so_far, total_so_far,
      correct_so_far / total_so_far * 100 as accuracy_pct
    from (select teacher, idx, correct,
            cast(sum(cast(correct as int)) over w as bigint) as correct_so_far,
            count(*) over w as total_so_far
          from graded window w as (partition by teacher order by idx))""",
    "running_accuracy_sparse": _graded()
    + """
    select teacher, idx * 10007 + idx * idx % 5003 as idx, correct, correct_so_far, total_so_far,
      correct_so_far / total_so_far * 100 as accuracy_pct
    from (select teacher, idx, correct,
            cast(sum(cast(correct as int)) over w as bigint) as correct_so_far,
            count(*) over w as total_so_far
          from graded window w as (partition by teacher order by idx))""",
    "sample_first5": _graded()
    + """
    select teacher, idx, question, ground_truth, predicted, left(response, 500) as full_response, correct
    from graded join predictions using (teacher, idx) join (select idx, question from test) using (idx)
    qualify row_number() over (partition by teacher order by idx) <= 5""",
    "best_model": _accuracy()
    + """
    select * from accuracy order by accuracy desc,
      list_position(['base', 'gpt', 'deepseek', 'gemini', 'original'], teacher) limit 1""",
    "summary_table": _accuracy()
    + f"""
    select {LABEL} as model, printf('%.2f%%', accuracy * 100) as accuracy_pct, correct, total
    from accuracy""",
    "upsert_results": _accuracy(
        graded_short=GRADED_SHORT, accuracy_short=ACCURACY.format(graded="graded_short")
    )
    + """
    select * from accuracy where teacher in ('gpt', 'deepseek', 'gemini')
    union all select * from accuracy_short where teacher not in ('gpt', 'deepseek', 'gemini')""",
    "combined_results": _accuracy(
        graded_short=GRADED_SHORT, accuracy_short=ACCURACY.format(graded="graded_short")
    )
    + """
    select *, 'full' as rules from accuracy union all select *, 'short' from accuracy_short""",
    "small_vs_full": _accuracy(
        few=_SAMPLED.format(table="test", rows=SMALL_ROWS),
        small=ACCURACY.format(graded="(select * from graded where idx in (select idx from few))"),
    )
    + """
    select teacher, s.accuracy as small_accuracy, s.total as small_total,
      f.accuracy as full_accuracy, f.total as full_total
    from small s full join accuracy f using (teacher)""",
    "eval_join_training": _with(
        "completions",
        "test",
        "predictions",
        extra={
            "graded": GRADED,
            "accuracy": ACCURACY.format(graded="graded"),
            "pairs": _PAIRS,
            "runs": RUN_FACTS,
        },
    )
    + "select * from accuracy left join runs using (teacher)",
    "gen_prompts": _with("train")
    + f"""
    select teacher, idx, concat({_INSTRUCTION}, chr(10), chr(10), 'Problem: ', question,
      chr(10), chr(10), 'Solution:') as prompt
    from train, (values ('gpt'), ('deepseek'), ('gemini')) v(teacher)""",
    "eval_prompts": _with("test")
    + f"""
    select idx, {_USER} as "user",
      concat({_turn("'user'", _USER)}, '<|im_start|>assistant', chr(10)) as chat from test""",
    "prompt_presets": _with("problems")
    + f"""
    select split, idx,
      concat({_INSTRUCTION}, chr(10), chr(10), 'Problem: ', question, chr(10), chr(10), 'Solution:')
        as generation,
      {_USER} as chat,
      concat('Solve this math problem step by step:', chr(10), chr(10), question) as short_train,
      concat({_str(fixed.SHORT_EVAL_INSTRUCTION)}, chr(10), chr(10), ' Problem: ', question)
        as short_eval
    from problems""",
    "train_text_by_teacher": _with("completions", extra={"pairs": _PAIRS})
    + f"""
    select teacher, idx, concat({_turn("'user'", _USER)}, {_turn("'assistant'", "target")}) as text
    from pairs""",
    "train_messages": _with("train")
    + f"""
    select idx, 2::bigint as turns, concat({_turn(
        "'user'",
        "concat('Solve this math problem step by step:', chr(10), chr(10), question)",
    )}, {_turn("'assistant'", "answer")}) as text
    from train""",
    "strip_prompt": _with("predictions")
    + f"select teacher, idx, trim(response, {WS}) as response from predictions",
    "chat_conversations": f"""
    select conv_id, count(*) as turns,
      string_agg(concat({_turn("role", "text")}), '' order by turn) as text
    from conversations group by conv_id""",
    "teachers_side_by_side": _with("completions")
    + """
    select idx, max(synthetic_answer) filter (where teacher = 'gpt') as gpt,
      max(synthetic_answer) filter (where teacher = 'deepseek') as deepseek,
      max(synthetic_answer) filter (where teacher = 'gemini') as gemini
    from completions group by idx""",
    "error_sentinel": _with("completions")
    + """
    select idx, question, answer, synthetic_answer, teacher,
      starts_with(synthetic_answer, 'ERROR:') as failed from completions""",
    "error_fallback": _with("outcomes", "train")
    + """
    select teacher, idx, case when ok then o.completion else p.answer end as synthetic_answer,
      not ok as fell_back
    from outcomes o join train p using (idx)""",
    "gen_stats": _with("outcomes", "totals", extra={"stats": STATS})
    + f"""
    select * replace ({_round("success_rate", 2)} as success_rate, {_round("minutes", 2)} as minutes,
      {_round("rows_per_min", 2)} as rows_per_min) from stats""",
    "gen_stats_total": _with("outcomes", "totals", extra={"stats": STATS})
    + f"""
    select 'all' as teacher, cast(sum(total) as bigint) as total, cast(sum(errors) as bigint) as errors,
      {_round("sum(minutes)", 2)} as minutes from stats""",
    "stats_lines": _with("outcomes", "totals", extra={"stats": STATS})
    + " union all ".join(
        f"select teacher, {i}::bigint as line_no, concat({_str(k + ': ')}, {v}) as value from stats"
        for i, (k, v) in enumerate(zip(STATS_KEYS, _STATS_VALUES))
    ),
    "stats_scan": _with("outcomes", "totals", extra={"stats": STATS})
    + f"""
    select teacher, total, successful, errors, {_round("success_rate", 2)} as success_rate,
      {_round("minutes", 1)} as minutes,
      concat('{OUTPUT}/teacher=', teacher) as output_file from stats""",
    "completion_errors": _with("completions")
    + f"""
    select *, total - errors as successful, {_round("100 * (total - errors) / total", 2)} as success_rate
    from (select teacher, count(*) as total,
            count(*) filter (where starts_with(synthetic_answer, 'ERROR:')) as errors
          from completions group by teacher)""",
    "gen_progress": _with("outcomes", "totals")
    + f"""
    select teacher, done, total, {_round("100 * done / total", 1)} as done_pct, errors,
      {_round("errors / done", 4)} as error_rate,
      {_round("done / (upto - start_s) * 60", 2)} as rows_per_min,
      {_round("(total - done) / (done / (upto - start_s)) / 60", 1)} as eta_min
    from (select teacher, idx, idx + 1 as done,
            cast(sum(cast(not ok as int)) over w as bigint) as errors, max(at_s) over w as upto
          from outcomes window w as (partition by teacher order by idx))
    join (select teacher, min(at_s) as start_s from attempts group by teacher) using (teacher), totals
    where done % 100 = 0""",
    "error_rate_blocks": _with("outcomes", extra={"blocks": BLOCKS})
    + """
    select *, errors / 100.0::double as error_rate, errors / 100.0 > 0.5 as trips from blocks""",
    "error_runs": _with("outcomes", extra={"runs": RUNS})
    + "select *, run_rows >= 10 as trips from runs",
    "circuit_breaker": _breaker() + _REPORT,
    "breaker_by_rounds": _breaker() + _REPORT,
    "completion_breaker": _breaker() + _REPORT,
    "generate_rounds": _breaker() + _REPORT,
    "circuit_breaker_rows": _breaker()
    + """
    select teacher, idx, case when ok then completion else concat('ERROR: ', error) end
      as synthetic_answer
    from outcomes left join trips using (teacher) where cut_idx is null or idx < cut_idx""",
    "backoff_totals": _with("attempts")
    + f"""
    select teacher, case when error = 'connection reset' then 'other' else 'rate_limit' end as kind,
      count(*) as failed_calls, count(wait) as retries, sum(coalesce(wait, 0)) as wait_s
    from (select *, {_BACKOFF} as wait from attempts where not ok)
    group by 1, 2""",
    "pending_work": _with("outcomes", "train")
    + """
    select idx, question, v.teacher from train, (values ('gpt'), ('deepseek'), ('gemini')) v(teacher)
    where not exists (select 1 from outcomes o where o.ok and o.idx = train.idx and o.teacher = v.teacher)""",
    "complete_with_retries": _with("attempts")
    + f"""
    select a.teacher, idx, attempt::bigint as attempt, ok, error,
      case when ok then concat(length(concat({_INSTRUCTION}, chr(10), chr(10), 'Problem: ', question,
        chr(10), chr(10), 'Solution:')), ' characters read by ', a.teacher) end as completion
    from attempts a join (select idx, question from train) using (idx)""",
    "sample_seeded": _with("train")
    + "select * exclude (n) from (" + _SAMPLED.format(table="train", rows=SMALL_ROWS) + ")",
    "sample_one": _with("train")
    + "select * exclude (n) from (" + _SAMPLED.format(table="train", rows=1) + ")",
    "first_n": _with("test") + f"select * from test where idx < {fixed.TEST_ROWS}",
    "problem_store": _with("test") + "select * from test",
    "raw_problem_scan": _with("train") + "select idx, 'train' as split, question, answer from train",
    "teacher_file_scan": _with("completions") + """
    select idx, question, answer, synthetic_answer, teacher from completions
    where teacher = 'gpt'""",
    "completion_store": _with("completions")
    + "select * from completions where teacher in ('gpt', 'gemini')",
    "results_document": _accuracy()
    + """
    select teacher, a.accuracy, a.correct as n_correct, a.total, n - 1 as sample_no,
      question, ground_truth, predicted as predicted_answer, left(response, 500) as full_response,
      s.correct
    from accuracy a join (
      select *, row_number() over (partition by teacher order by idx) as n
      from graded join predictions using (teacher, idx)
      join (select idx, question from test) using (idx)) s using (teacher)
    where n <= 5""",
    "training_log": _with(
        "completions",
        "test",
        "predictions",
        extra={
            "graded": GRADED,
            "accuracy": ACCURACY.format(graded="graded"),
            "pairs": _PAIRS,
            "runs": RUN_FACTS,
        },
    )
    + f"""
    select teacher, strftime(first_day, '%Y-%m-%d') as started_on,
      case when teacher = 'original' then 'original' else concat('{OUTPUT}/teacher=', teacher) end
        as source,
      train_size, 'Qwen/Qwen2.5-1.5B-Instruct' as student_model,
      coalesce({_MODEL}, 'Original answers') as teacher_model,
      1e-5::double as learning_rate, 4::bigint as batch_size,
      4::bigint as gradient_accumulation_steps,
      16::bigint as effective_batch_size, 2::bigint as num_epochs, 512::bigint as max_seq_length,
      64::bigint as lora_r,
      128::bigint as lora_alpha, 0.08::double as lora_dropout, total_steps,
      {_round("date_diff('microsecond', first_day, last_day) / 6e7", 2)} as time_minutes,
      {_round("1 - accuracy", 4)} as final_loss, 73859072::bigint as trainable_params,
      962475520::bigint as total_params,
      7.67::double as trainable_percent, concat('models/', teacher, '/adapter') as output_path
    from runs join accuracy using (teacher),
      (select min(o_orderdate) as first_day, max(o_orderdate) as last_day from orders)""",
    "stream_accuracy": _accuracy() + "select * from accuracy",
    "bucketed_grading": _accuracy() + "select * from accuracy",
    "bucketed_pending": _with("outcomes", "train")
    + """
    select idx, question, v.teacher from train, (values ('gpt'), ('deepseek'), ('gemini')) v(teacher)
    where not exists (select 1 from outcomes o where o.ok and o.idx = train.idx and o.teacher = v.teacher)""",
    "stream_breaker": _breaker() + _REPORT,
    # a second answer, where there is one, decides: right for an even idx
    "stream_corrections": _graded()
    + f"""
    select teacher, correct, total, {_round("correct / total", 4)} as accuracy
    from (select teacher, count(*) as total,
            count(*) filter (where case when idx % 7 = 3 then idx % 2 = 0 else correct end) as correct
          from graded group by teacher)""",
    "stream_errors": _with("outcomes")
    + """
    select teacher, count(*) as processed, count(*) filter (where not ok) as errors
    from outcomes group by teacher""",
    "annotations": _with("problems")
    + f"""
    select split, idx, {_count("answer", ANNOTATION)} as annotations,
      array_to_string(regexp_extract_all(answer, '{ANNOTATION_PARTS}', 1), ';') as expressions,
      array_to_string(regexp_extract_all(answer, '{ANNOTATION_PARTS}', 2), ';') as results,
      regexp_replace(answer, '{ANNOTATION}', '', 'g') as plain
    from problems""",
    "style_profile": _profile("text", "lang, source", "documents"),
    "style_profile_teachers": _with("completions")
    + _profile("synthetic_answer", "teacher", "completions"),
}
ORACLE["results_format"] = ORACLE["results_document"]
# gaps in idx change no position, so the dense log gives the same blocks, progress and counts
ORACLE["error_rate_blocks_sparse"] = ORACLE["error_rate_blocks"]
ORACLE["gen_progress_sparse"] = ORACLE["gen_progress"]
ORACLE["circuit_breaker_sparse"] = _breaker() + f"select * exclude (cut_idx) from ({_REPORT})"
