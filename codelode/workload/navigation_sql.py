"""SQL of the navigation queries: common tables and statements over them."""

from __future__ import annotations

CTE: dict[str, str] = {}
BODIES: dict[str, str] = {}

CTE["g_terms"] = "select distinct query_id, unnest(list_transform(terms, lambda t: replace(t, '_', ' '))) as term from requests"
CTE["g_found"] = """
select query_id, path, count(*) as n_terms
from g_terms join (select term, path from (select distinct term from g_terms), files where contains(text, term)) using (term) group by all"""
CTE["g_files"] = "select query_id, row_number() over (partition by query_id order by path) as position, path, n_terms from g_found"
BODIES["grep_files"] = "select query_id, position, path, n_terms from g_files"

CTE["g_texts"] = "select path, text, string_split_regex(text, '\\r?\\n') as l from files"
CTE["g_lines"] = "select path, len(l) as n_lines, unnest(l) as line, unnest(range(1, len(l) + 1)) as line_no from g_texts"
CTE["g_hits"] = """
select distinct query_id, path, line_no, n_lines
from g_terms join (select term, path, line_no, n_lines from (select distinct term from g_terms), g_lines where contains(line, term)) using (term)"""
CTE["g_spans"] = """
select *, greatest(line_no - 2, 1) as lo, least(line_no + 2, n_lines) as hi,
  lag(least(line_no + 2, n_lines)) over (partition by query_id, path order by line_no) as reach from g_hits"""
BODIES["grep_context"] = """
select query_id, path, min(lo) as start_line, max(hi) as end_line, count(*) as matches
from (select *, count(*) filter (lo > reach + 1) over (partition by query_id, path order by line_no) as island from g_spans)
group by query_id, path, island"""

CTE["g_first"] = """
select f.query_id, f.position, f.path, t.l, coalesce(min(h.line_no), 1) as hit
from g_files f join g_texts t using (path) left join g_hits h on h.query_id = f.query_id and h.path = f.path
where f.position <= 5 and t.text <> '' group by all"""
CTE["g_snips"] = "select query_id, position, path, greatest(hit - 2, 1) as start_line, l[greatest(hit - 2, 1):hit + 2] as lines from g_first"
BODIES["grep_snippets"] = "select query_id, position, path, start_line, array_to_string(lines, chr(10)) as lines from g_snips"

CTE["g_shown"] = """
select query_id, string_agg('--- ' || path || ':' || start_line || chr(10) ||
  array_to_string(list_transform(lines, lambda x, i: (start_line + i - 1) || ': ' || x), chr(10)), chr(10) order by position) as context
from g_snips group by 1"""
CTE["g_words"] = """
select query_id, position, line_no, unnest(w) as term, unnest(range(1, len(w) + 1)) as word_no
from (select query_id, position, line_no, regexp_extract_all(line, '\\b[A-Za-z_][A-Za-z0-9_]{2,}\\b') as w
  from (select query_id, position, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as line_no from g_snips))"""
CTE["g_new"] = """
select query_id, list(term order by seen)[1:25] as found
from (select query_id, term, min(position * 1000000000000 + line_no * 100000000 + word_no) as seen from g_words
  where lower(term) not in ('assert', 'class', 'def', 'false', 'for', 'from', 'import', 'none', 'return', 'self', 'true') group by 1, 2) group by 1"""
_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
BODIES["grep_steps"] = f"""
select s.query_id, sha256(context) as context, length(context) as context_chars, ceil(length(context) / 4)::bigint as context_tokens,
  array_to_string(coalesce(found, []), ' ') as found,
  array_to_string(case when s.query_id % 2 = 0 and len(terms) > 0
    then list_filter(terms, lambda t: list_contains(list_transform(coalesce(found, []), lambda x: {_PLAIN.format('x')}), {_PLAIN.format('t')}))
    else coalesce(found, [])[1:5] end, ' ') as next_terms
from g_shown s join requests r using (query_id) left join g_new n using (query_id)"""

BODIES["top_level_symbols"] = """
select path, row_number() over (partition by s.file_id order by s.start_line, s.symbol_id) as place, s.symbol_id, s.qualified_name as symbol
from symbols s join files f on f.file_id = s.file_id left join symbols p on p.symbol_id = s.parent_symbol_id
where (s.parent_symbol_id is null or p.kind = 'module') and s.kind in ('class', 'function', 'method', 'typealias')"""

_LOOSE = "lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-./]+', ' ', 'g'))"
CTE["y_hints"] = f"""
select source_id, list_filter(list_distinct(list_concat(
  flatten(list_transform(terms, lambda t: string_split_regex({_LOOSE.format('t')}, '\\s+'))),
  list_transform(string_split_regex(regexp_replace(coalesce(symbol, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda t: {_LOOSE.format('t')}))),
  lambda t: length(t) >= 3) as hints from t_sources"""
CTE["y_symbols"] = f"""
select f.path, s.symbol_id, s.qualified_name as name, {_LOOSE.format('s.qualified_name')} as whole, {_LOOSE.format("string_split(s.qualified_name, '.')[-1]")} as leaf
from symbols s join files f using (file_id) where f.role = 'test' and s.kind in ('function', 'method', 'class') and s.qualified_name <> ''"""
CTE["y_scored"] = """
select *, case when starts_with(leaf, 'test') then 8 when own > 0 then 10 else 0 end + 12 * own + 3 * other as points,
  count(*) over (partition by source_id, path) as n_symbols, max(own) over (partition by source_id, path) as most_own
from (select source_id, y.*, len(list_filter(hints, lambda t: contains(leaf, t))) as own,
    len(list_filter(hints, lambda t: not contains(leaf, t) and contains(whole, t))) as other
  from r_g g join y_hints using (source_id) join y_symbols y on y.path = g.path)"""
BODIES["test_symbols"] = """
select source_id, path as file, n_symbols, string_agg(name, ',' order by place) as symbols
from (select *, row_number() over (partition by source_id, path order by case when n_symbols > 32 then -points else 0 end, symbol_id) as place
  from y_scored where n_symbols <= 32 or most_own = 0 or own > 0)
where place <= 32 group by 1, 2, 3"""

CTE["w_values"] = "select case_id as query_id, unnest(found) as value from turns where step = 1"
CTE["w_hits"] = """
select v.query_id, min(t.step - 1) as symbol_position from (select distinct query_id from w_values) v
left join (select t.case_id, t.step from turns t join w_values v on v.query_id = t.case_id and v.value = t.found[-1] where t.step > 1) t on t.case_id = v.query_id group by 1"""
CTE["w_said"] = """
select query_id, bool_or(coalesce(contains(lower(a.text), lower(value)), false)) as symbol_mention
from w_values v left join (select case_id, string_agg(text, ' ' order by step) as text from turns where role = 'assistant' group by 1) a on a.case_id = v.query_id group by 1"""
BODIES["answer_winners"] = """
select query_id, symbol_position, symbol_mention,
  case when symbol_position = 1 and symbol_mention then 'tie' when symbol_position = 1 then 'index'
    when coalesce(symbol_position, 6) > 5 and symbol_mention then 'answers' else 'inconclusive' end as winner
from w_hits join w_said using (query_id)"""

CTE["x_seen"] = """
select v.query_id as case_id, v.value, min(t.step) as seen
from w_values v left join (select case_id, step, unnest(found) as value from turns where step > 1) t on t.case_id = v.query_id and t.value = v.value group by all"""
CTE["x_steps"] = """
select t.case_id, count(*) over (partition by t.case_id) as commands, step,
  sum(tokens) over w as tokens, sum(length(text)) over w as ms from turns t where step > 1
window w as (partition by t.case_id order by step rows unbounded preceding)"""
CTE["x_first"] = """
select c.case_id, c.n_wanted, min(seen) as first_useful, case when count(seen) = c.n_wanted then max(seen) end as completed_at, count(seen) = c.n_wanted as complete
from (select case_id, len(found) as n_wanted from turns where step = 1) c left join x_seen s using (case_id) group by c.case_id, c.n_wanted"""
CTE["x_runs"] = """
select f.case_id, (select max(commands) from x_steps s where s.case_id = f.case_id) as commands, first_useful, completed_at,
  a.tokens::bigint as first_useful_tokens, a.ms::bigint as first_useful_ms,
  case when complete then coalesce(b.tokens, 0) end::bigint as completion_tokens, case when complete then coalesce(b.ms, 0) end::bigint as completion_ms
from x_first f left join x_steps a on a.case_id = f.case_id and a.step = f.first_useful
left join x_steps b on b.case_id = f.case_id and b.step = f.completed_at"""
CTE["x_limits"] = """
select *, case when case_id % 3 = 0 then 'first' else 'used' end as expected,
  case when case_id % 4 = 0 then 3 when case_id % 3 = 0 then 1 else 2 end as max_first,
  case when case_id % 5 = 0 then 4 end as m0, case when case_id % 2 = 0 then 200 end as m1, case when case_id % 7 = 0 then 900 end as m2,
  case when case_id % 6 = 0 then 40 end as m3, case when case_id % 11 = 0 then 200 end as m4
from (select case_id, commands, case when commands is not null then first_useful end as first_useful,
  case when commands is not null then completed_at end as completed_at, case when commands is not null then first_useful_tokens end as first_useful_tokens,
  case when commands is not null then first_useful_ms end as first_useful_ms, case when commands is not null then completion_tokens end as completion_tokens,
  case when commands is not null then completion_ms end as completion_ms from x_runs)"""


def _over(value: str, limit: str, name: str) -> str:
    return f"case when {limit} is not null and {value} is null then 'no {name}' when {value} > {limit} then '{name} ' || {value} || ' over ' || {limit} end"


_CHECKS = ", ".join([
    "case when coalesce(commands, 0) = 0 then 'tool was not called' end",
    "case when first_useful is null then 'nothing useful found' when first_useful > max_first then 'first useful command ' || first_useful || ' over ' || max_first end",
    _over("completed_at", "m0", "completion command"), _over("first_useful_ms", "m1", "first useful latency"), _over("completion_ms", "m2", "completion latency"),
    _over("first_useful_tokens", "m3", "first useful tokens"), _over("completion_tokens", "m4", "completion tokens"),
])
CTE["x_scored"] = f"select *, list_filter([{_CHECKS}], lambda r: r is not null) as reasons from x_limits"
BODIES["tool_use"] = """
select case_id, expected, len(reasons) = 0 as satisfied, first_useful, completed_at, first_useful_ms, completion_ms, first_useful_tokens, completion_tokens,
  array_to_string(reasons, '; ') as reasons from x_scored"""
BODIES["tool_use_rates"] = """
select count(*) as tool_use_cases, round(avg(case when len(reasons) = 0 then 1.0 else 0.0 end), 4) as tool_use_rate,
  round(avg(first_useful_tokens), 4) as tool_use_first_useful_tokens, round(avg(completion_tokens), 4) as tool_use_completion_tokens,
  round(avg(first_useful_ms), 4) as tool_use_first_useful_ms, round(avg(completion_ms), 4) as tool_use_completion_ms from x_scored"""

CTE["z_cases"] = """
select user_id::varchar as name, event_type, value as v, (props->>'$.k')::int as k, value >= 15 as won, value >= 20 as won_optimised from events"""
_STATS = """count(*) filter (coalesce(k % 5, 1) <> 0) as eligible_cases, count(*) filter (coalesce(k % 5, 1) <> 0 and won) as eligible_wins,
  count(*) filter (coalesce(k % 5, 1) <> 0 and won_optimised) as eligible_wins_vs_optimised"""
BODIES["case_stats"] = f"select name, event_type, {_STATS} from z_cases group by 1, 2"
CTE["z_suite"] = f"""
select event_type, name, count(*)::double as cases, round(avg(case when v >= 10 then 1.0 else 0.0 end), 6) as completion_rate,
  round(avg(case when v >= 12 then 1.0 else 0.0 end), 6) as optimised_completion_rate, round(avg(case when k % 2 = 0 then 1.0 else 0.0 end), 6) as broad_completion_rate,
  count(*) filter (won)::double as wins, count(*) filter (won_optimised)::double as wins_vs_optimised,
  round(avg(v) filter (v >= 0), 6) as avg_context_tokens, round(avg(v) filter (k % 3 = 0), 6) as avg_first_useful_tokens,
  round(avg(v) filter (k % 2 = 0), 6) as avg_latency_ms, round(avg(v) filter (k % 2 = 1), 6) as avg_first_useful_ms,
  round(avg(v) filter (v >= 5), 6) as broad_context_tokens, round(avg(v) filter (v < 25), 6) as optimised_context_tokens,
  count(*) filter (k % 7 = 0)::double as tool_use_cases, round(avg(case when v >= 8 then 1.0 else 0.0 end) filter (k % 7 = 0), 6) as tool_use_rate,
  round(avg(v) filter (k % 7 = 0), 6) as tool_use_first_useful_tokens, round(avg(v) filter (k % 7 = 0 and v >= 8), 6) as tool_use_completion_ms, {_STATS}
from (select * from z_cases union all select * replace ('' as name) from z_cases) group by 1, 2"""
CTE["z_both"] = """
select b.name, b.name = '' as whole, c.name is not null as there, b as b, c as c,
  b.name = '' and coalesce(c.tool_use_cases, 0) <= 0 as unused, coalesce(b.tool_use_cases, 0) = 0 and coalesce(c.tool_use_cases, 0) = 0 as idle
from (select * from z_suite where event_type = 'view') b left join (select * from z_suite where event_type = 'click') c on c.name = b.name"""


def _rule(metric: str, rule: str, bad: str, before: str, after: str) -> str:
    return f"select name, '{metric}' as metric, '{rule}' as rule, {before}::double as baseline, {after}::double as current from z_both where there and {bad}"


def _budgets(metrics: tuple[str, ...], more: float, percent: float, when: str = "true") -> list[str]:
    return [_rule(m, "budget", f"{when} and c.{m} > b.{m} + greatest({more}, b.{m} * ({percent} / 100.0))", f"b.{m}", f"c.{m}") for m in metrics]


_SCORED = "not unused and not idle"
_RULES = [
    "select name, 'name' as metric, 'missing' as rule, 1.0::double as baseline, 0.0::double as current from z_both where not there",
    *[_rule(m, "lower", f"{when} and c.{m} < b.{m}", f"b.{m}", f"c.{m}") for m, when in (
        ("cases", "whole"), ("completion_rate", "true"), ("wins", "whole"), ("wins_vs_optimised", "true"), ("tool_use_cases", _SCORED))],
    _rule("tool_use_rate", "lower", f"{_SCORED} and coalesce(c.tool_use_rate, 0) < coalesce(b.tool_use_rate, 0)", "coalesce(b.tool_use_rate, 0)", "coalesce(c.tool_use_rate, 0)"),
    _rule("tool_use_cases", "required", "unused", "1.0", "coalesce(c.tool_use_cases, 0)"),
    _rule("tool_use_rate", "required", f"whole and {_SCORED} and coalesce(c.tool_use_rate, 0) < 1", "1.0", "coalesce(c.tool_use_rate, 0)"),
    *_budgets(("avg_context_tokens", "avg_first_useful_tokens"), 1.5, 10), *_budgets(("tool_use_first_useful_tokens",), 1.5, 10, _SCORED),
    *_budgets(("avg_latency_ms", "avg_first_useful_ms"), 2.0, 5), *_budgets(("tool_use_completion_ms",), 2.0, 5, _SCORED),
    *[_rule(f"completion_rate against {g}", "dominated", f"c.completion_rate < c.{g}_completion_rate", f"c.{g}_completion_rate", "c.completion_rate") for g in ("broad", "optimised")],
    *[_rule(f"avg_context_tokens against {g}", "dominated", f"c.avg_context_tokens >= c.{g}_context_tokens", f"c.{g}_context_tokens", "c.avg_context_tokens") for g in ("broad", "optimised")],
    *[_rule(m, "dominated", f"c.eligible_{m} < c.eligible_cases", "c.eligible_cases", f"c.eligible_{m}") for m in ("wins", "wins_vs_optimised")],
]
BODIES["suite_regressions"] = "\nunion all ".join(_RULES)
