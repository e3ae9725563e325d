"""The same results in ANSI-style SQL over the given tables, for DuckDB."""

from __future__ import annotations

from codelode.operators import related, source_tests
from codelode.functions.intent import ENTRY_SEEDS, LITERAL_RULES
from codelode.workload import feature_sql as fs
from codelode.workload import navigation_sql


def strict(x: str) -> str:
    return (
        f"trim(regexp_replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    )


def loose(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\-./]+', ' ', 'g'))"


def stem(t: str) -> str:
    return (
        f"case when {t} like '%ing' and length({t}) > 5 then left({t}, length({t}) - 3) "
        f"when {t} like '%ed' and length({t}) > 4 then left({t}, length({t}) - 2) "
        f"when {t} like '%s' and length({t}) > 3 then left({t}, length({t}) - 1) else {t} end"
    )


def distinct_list(l: str) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def fts(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}]+')"


def camel(w: str) -> str:
    return f"upper(left({w}, 1)) || lower(substr({w}, 2))"


CTE: dict[str, str] = {}

CTE["docs"] = """
select doc_id as file_id, text, source, lang,
  case when source in ('src0', 'src1', 'src2') then 'tests' when source = 'src3' then 'docs'
       when source = 'src4' then 'examples' when source = 'src5' then 'fixtures'
       when source = 'src6' then 'tools' when source = 'src7' then 'benchmarks' else 'lib' end as folder,
  case when regexp_extract(text, '[A-Za-z]{3,}') = '' then 'doc' else lower(regexp_extract(text, '[A-Za-z]{3,}')) end as slug,
  case lang when 'en' then '.py' when 'de' then '.go' when 'fr' then '.rs' else '.kt' end as ending
from documents"""
CTE["files"] = """
select file_id, text,
  folder || '/' || source || '/' || file_id || '/' || case when folder = 'tests' then 'test_' else '' end || slug || ending as path,
  sha256(text) as hash,
  case ending when '.py' then 'python' when '.go' then 'go' when '.rs' then 'rust' else 'kotlin' end as language,
  case folder when 'tests' then 'test' when 'docs' then 'docs' when 'examples' then 'example'
    when 'fixtures' then 'fixture' when 'tools' then 'tool' when 'benchmarks' then 'benchmark' else 'source' end as role
from docs"""
CTE["raw_lines"] = """
select file_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as line_no
from (select file_id, string_split(text, chr(10)) as l from docs)"""
CTE["lines"] = """
select file_id, line_no, line, regexp_extract_all(line, '[A-Za-z]{2,}') as ws from raw_lines
where len(regexp_extract_all(line, '[A-Za-z]{2,}')) >= 2"""
CTE["named"] = f"""
select file_id, line_no, line, file_id * 16777216 + line_no as symbol_id, lower(ws[1]) as first_word,
  case when len(ws) >= 60 then 'class' when len(ws) >= 25 then 'method' else 'function' end as kind,
  case when len(ws) >= 60 then {camel('ws[1]')} || {camel('ws[2]')} else lower(ws[1]) || '_' || lower(ws[2]) end as name,
  regexp_extract_all(line, '[.!?] ([A-Za-z]{{2,}} [A-Za-z]{{2,}})', 1) as openings
from lines"""
CTE["owned"] = """
select *, last_value(case when kind = 'class' then symbol_id end ignore nulls) over w as owner_id,
  last_value(case when kind = 'class' then name end ignore nulls) over w as owner_name
from named window w as (partition by file_id order by line_no rows between unbounded preceding and 1 preceding)"""
CTE["members"] = """
select symbol_id, file_id, name,
  case when kind = 'method' and owner_id is not null then owner_name || '.' || name else name end as qualified_name,
  kind, line_no as start_line, line_no as end_line,
  case when kind = 'method' and owner_id is not null then owner_id else file_id * 16777216 end as parent_symbol_id,
  line as text, openings, first_word
from owned"""
CTE["symbols"] = """
select file_id * 16777216 as symbol_id, file_id, path as name, path as qualified_name, 'module' as kind,
  1 as start_line, len(string_split(text, chr(10))) as end_line, null::bigint as parent_symbol_id, text
from files
union all
select symbol_id, file_id, name, qualified_name, kind, start_line, end_line, parent_symbol_id, text from members"""
CTE["units"] = """
select s.symbol_id as chunk_id, s.symbol_id, s.file_id, s.name, s.qualified_name, s.kind, s.start_line as symbol_start,
  s.text, f.path, f.role, f.language
from symbols s join files f using (file_id)"""
CTE["raw_edges"] = f"""
select file_id, file_id * 16777216 as source_symbol_id, 'lib.' || first_word as target_name,
  'symbol_imports_module' as kind, 0 as sort, min(start_line) as line_no, 0 as idx
from members group by all
union all
select file_id, symbol_id,
  case when kind = 'class' then {camel("split_part(o, ' ', 1)")} || {camel("split_part(o, ' ', 2)")}
       else lower(split_part(o, ' ', 1)) || '_' || lower(split_part(o, ' ', 2)) end,
  case when kind = 'class' then 'symbol_conforms_to' else 'symbol_calls_name' end, 1, start_line, idx
from (select file_id, symbol_id, kind, start_line, unnest(openings) as o, unnest(range(0, len(openings))) as idx from members)
where kind <> 'class' or idx = 0"""
CTE["edges"] = """
select e.file_id * 16777216 + row_number() over (partition by e.file_id order by sort, line_no, idx, e.target_name) as edge_id,
  source_symbol_id,
  coalesce(b.bound_id, case when e.kind = 'symbol_conforms_to' then coalesce(q.id, n.id) end) as target_symbol_id,
  e.target_name, e.kind
from raw_edges e
left join (select file_id, qualified_name, max(symbol_id) as bound_id from members group by all) b
  on b.file_id = e.file_id and b.qualified_name = e.target_name
left join (select qualified_name, min(symbol_id) as id from members group by all) q on q.qualified_name = e.target_name
left join (select name, min(symbol_id) as id from members group by all) n on n.name = e.target_name"""
CTE["requests0"] = f"""
select item_id as query_id,
  list_concat(
    list_transform(regexp_extract_all(text, '(?:^|[.!?]\\s)([A-Za-z]{{2,}} [A-Za-z]{{2,}})', 1), lambda s: lower(replace(s, ' ', '_'))),
    list_transform(regexp_extract_all(text, '[\\p{{L}}]{{7,}}'), lambda s: lower(s))) as all_terms,
  case when item_id % 4 = 1 then ['function', 'method'] end as kinds,
  case when item_id % 5 = 2 then ['source'] when item_id % 7 = 3 then ['test'] end as roles,
  item_id % 6 = 4 as exclude_support,
  case when item_id % 3 = 0 then ['lib/src8', 'src9/'] when item_id % 3 = 1 then ['src1_/' || item_id || '/the.py', 'src8'] end as path_hints,
  case when item_id % 9 = 0 then 'filter' else 'boost' end as path_mode,
  case when item_id % 8 = 5 then []::varchar[] end as expand
from benchmark"""
CTE["requests"] = f"""
select *, array_to_string(terms, ' ') as question
from (select * exclude (all_terms), {distinct_list('all_terms')} as terms from requests0)"""
CTE["ranked"] = f"""
select query_id, list_filter({distinct_list('pairs')}, lambda t: length(t) >= 2) as q_tokens
from (select query_id, flatten(list_transform(
  list_filter(string_split({strict('question')}, ' '), lambda t: length(t) >= 2), lambda t: [t, {stem('t')}])) as pairs from requests)"""
CTE["tokens"] = f"""
select chunk_id, kind, role, len(a) + len(b) + len(c) as dl, list_concat(a, [''], b, [''], c) as toks
from (select chunk_id, kind, role, {fts("text || chr(10) || " + strict('text') + " || chr(10) || " + strict('qualified_name'))} as a,
  {fts('qualified_name')} as b, {fts('path')} as c from units)"""
CTE["posts"] = """
select chunk_id, kind, role, dl, term, count(*) as tf
from (select chunk_id, kind, role, dl, unnest(toks) as term from tokens) where term <> '' group by all"""
CTE["stats"] = "select count(*)::double as n, avg(dl) as avgdl from tokens"
CTE["phrases"] = "select query_id, unnest(q_tokens) as phrase from ranked"

_ALLOWED = (
    "(path_mode <> 'filter' or path_hints is null or len(path_hints) = 0 or len(list_filter(path_hints, lambda h: "
    "len(list_filter(regexp_extract_all(lower(h), '[a-z0-9]+'), lambda t: not contains(lower(path), t))) = 0)) > 0)"
)
_HARD = (
    "(kinds is null or list_contains(kinds, kind)) and (roles is null or list_contains(roles, role)) "
    "and (not exclude_support or role = 'source')"
)


def weights(hits: str) -> str:
    """BM25 parts over (phrase, chunk_id, kind, role, dl, f)."""
    return f"""
select h.*, -(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end)
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) as w
from {hits} h join (select phrase, count(*) as df from {hits} group by phrase) d using (phrase), stats"""


CTE["hits"] = """
select phrase, chunk_id, kind, role, dl, tf as f from posts join (select distinct phrase from phrases) p on p.phrase = posts.term"""
CTE["parts"] = weights("hits")
CTE["fts_all"] = f"""
select query_id, chunk_id, round(sum(w), 9) as rank
from parts join phrases using (phrase) join requests using (query_id) join units u using (chunk_id)
where {_HARD.replace('kind)', 'u.kind)').replace('role)', 'u.role)').replace('or role =', 'or u.role =')} and {_ALLOWED}
group by all"""
CTE["fts_top"] = """
select query_id, chunk_id, rank, fts_position
from (select *, row_number() over (partition by query_id order by rank, chunk_id) as fts_position from fts_all) join requests using (query_id)
where fts_position <= case when list_contains(coalesce(roles, []), 'test') then 100 else 25 end"""
CTE["exact_top"] = f"""
select query_id, chunk_id, position from (
  select query_id, chunk_id, row_number() over (partition by query_id order by path, symbol_start, chunk_id) as position
  from (
    select distinct r.query_id, u.chunk_id, u.path, u.symbol_start
    from (select *, unnest(list_filter(terms, lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_:.#-]*$') and regexp_matches(t, '[A-Z_:.#-]'))[1:12]) as term from requests) r
    join units u on lower(u.name) = lower(r.term) or lower(u.qualified_name) = lower(r.term)
    where {_HARD} and {_ALLOWED}))
where position <= 40"""
CTE["hint_top"] = f"""
select query_id, chunk_id, position from (
  select query_id, chunk_id, row_number() over (partition by query_id order by path, symbol_start, chunk_id) as position
  from (
    select distinct r.query_id, u.chunk_id, u.path, u.symbol_start
    from (select *, unnest(path_hints) as hint from requests) r
    join units u on regexp_matches(hint, '/.+\\.[A-Za-z0-9]+$') and (lower(u.path) like lower(hint) or lower(u.path) like '%/' || lower(hint))
    where {_HARD} and {_ALLOWED}))
where position <= 30"""
CTE["pool_words"] = """
select query_id, unnest(w) as word, unnest(range(0, len(w))) as place
from (select query_id, list_filter(q_tokens, lambda t: length(t) >= 3)[1:8] as w from ranked)"""
CTE["word_lists"] = f"select distinct word, unnest([word, {stem('word')}]) as phrase from pool_words"
CTE["word_hits"] = """
select phrase, chunk_id, kind, role, dl, tf as f from posts
join (select distinct phrase from word_lists where length(phrase) >= 2) p on p.phrase = posts.term"""
CTE["word_parts"] = weights("word_hits")
CTE["word_top"] = f"""
select query_id, word, chunk_id, rank from (
  select query_id, word, chunk_id, rank, row_number() over (partition by query_id, word order by rank, chunk_id) as rn
  from (
    select w.query_id, w.word, p.chunk_id, round(sum(p.w), 9) as rank
    from pool_words w join (select distinct * from word_lists) using (word) join word_parts p using (phrase)
    join requests r on r.query_id = w.query_id join units u on u.chunk_id = p.chunk_id
    where {_HARD.replace(', kind)', ', u.kind)').replace(', role)', ', u.role)').replace('or role =', 'or u.role =')} and {_ALLOWED}
    group by all))
where rn <= 80"""
CTE["pool"] = """
select query_id, chunk_id, rank, source_rank, kind, position from (
  select *, row_number() over (partition by query_id order by source_rank, rank, path, symbol_start, chunk_id) as position
  from (select query_id, chunk_id, min(rank) as rank, min(place) as source_rank from pool_words join word_top using (query_id, word) group by all) p
  join units using (chunk_id))
where position <= 300"""
CTE["merged"] = """
select query_id, chunk_id, max(boost) as boost, min(rank) as rank, min(fts_position) as fts_position,
  min(source * 1000 + position) as first_place
from (
  select query_id, chunk_id, 0 as source, position, 0.0 as rank, null as fts_position, 42.0 as boost from exact_top
  union all select query_id, chunk_id, 1, position, 0.0, null, 0.0 from hint_top
  union all select query_id, chunk_id, 3, fts_position, rank, fts_position, 0.0 from fts_top)
group by all"""


def sql(body: str, *extra: tuple[str, str]) -> str:
    """A statement with the common tables it needs, in dependency order."""
    import re

    names = {**CTE, **dict(extra)}
    needed: list[str] = []
    seen: set[str] = set()

    def add(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in names:
            if name in words and name not in seen and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\b", text):
                seen.add(name)
                add(names[name])
                needed.append(name)

    add(body)
    parts = ",\n".join(f"{name} as materialized ({names[name]})" for name in needed)
    return f"with {parts}\n{body}" if parts else body


ORACLES: dict[str, str] = {
    "files": sql("select file_id, path, hash, language, role from files"),
    "role_counts": sql(
        "select r.role, count(f.file_id) as files from (select unnest(['source','test','docs','example','fixture','tool','benchmark']) as role) r "
        "left join files f using (role) group by 1"
    ),
    "symbols": sql("select symbol_id, file_id, name, qualified_name, kind, start_line::int as start_line, end_line::int as end_line, parent_symbol_id from symbols"),
    "edges": sql("select edge_id, source_symbol_id, target_symbol_id, target_name, kind from edges"),
    "relation_counts": sql(
        "select 'files' as relation, count(*) as row_count from files union all select 'symbols', count(*) from symbols "
        "union all select 'chunks', count(*) from units union all select 'edges', count(*) from edges"
    ),
    "implementation_edges": sql("""
select gi.symbol_id as source_symbol_id, re.symbol_id as target_symbol_id, re.qualified_name as target_name
from edges c join symbols ct on ct.symbol_id = c.source_symbol_id and ct.kind = 'class'
join symbols pt on pt.symbol_id = c.target_symbol_id and pt.kind = 'class'
join symbols re on re.parent_symbol_id = pt.symbol_id and re.kind in ('function', 'method')
join symbols gi on gi.parent_symbol_id = ct.symbol_id and gi.name = re.name and gi.kind = re.kind
where c.kind = 'symbol_conforms_to' and not exists (
  select 1 from edges x where x.source_symbol_id = gi.symbol_id and x.target_symbol_id = re.symbol_id and x.kind = 'symbol_conforms_to')"""),
    "postings": sql("select term, count(*) as chunks, sum(tf)::bigint as occurrences, sum(dl)::bigint as length_sum from posts group by 1"),
    "corpus_stats": sql("select n::bigint as n, round(avgdl, 6) as avgdl from stats"),
    "fts_topk": sql("select query_id, chunk_id, round(rank, 6) as rank, fts_position from fts_top"),
    "exact_symbol_candidates": sql("select query_id, chunk_id, position from exact_top"),
    "path_hint_candidates": sql("select query_id, chunk_id, position from hint_top"),
    "intent_pool": sql("select query_id, chunk_id, round(rank, 6) as rank, source_rank, kind, position from pool"),
    "candidate_merge": sql("select query_id, chunk_id, boost, round(rank, 6) as rank, fts_position, first_place from merged"),
}


def evidence(text: str, terms: str) -> str:
    """First trimmed line with most terms; the words are already lower case."""
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda s: trim(s)), lambda s: s <> '')"
    scored = (
        f"list_transform({lines}, lambda s: struct_pack(l := s, n := list_sum(list_transform({terms}, "
        f"lambda t: contains({loose('s')}, t)::int))))"
    )
    best = f"coalesce(list_reduce({scored}, lambda a, b: case when b.n > a.n then b else a end, struct_pack(l := {lines}[1], n := 0)).l, '')"
    return f"(select case when length(e) > 96 then rtrim(left(e, 93)) || '...' else e end from (select regexp_replace({best}, '\\s+', ' ', 'g') as e))"


CTE["fts_unique"] = """
select * from (
  select t.query_id, t.chunk_id, t.rank, t.fts_position, u.qualified_name, u.kind, u.path, u.symbol_start, u.text,
    row_number() over (partition by t.query_id, u.path, u.qualified_name order by t.fts_position) as rn
  from fts_top t join units u using (chunk_id)) where rn = 1"""
ORACLES["search_fts"] = sql(f"""
select query_id, position, qualified_name as symbol, kind, path as file, symbol_start::int as start_line,
  round(round(-rank, 3), 2) as score, {evidence('text', 'q_tokens')} as evidence
from (select *, row_number() over (partition by query_id order by fts_position) as position from fts_unique) join ranked using (query_id)
where position <= 5""")

CTE["near"] = """
select symbol_id, row_number() over (partition by symbol_id order by side, rn) as place, relation, neighbour, path, edge_id
from (
  select e.source_symbol_id as symbol_id, 0 as side, row_number() over (partition by e.source_symbol_id order by e.edge_id) as rn,
    e.kind as relation, e.target_name as neighbour, f.path, e.edge_id
  from edges e left join symbols s on s.symbol_id = e.target_symbol_id left join files f on f.file_id = s.file_id
  union all
  select i.symbol_id, 1, row_number() over (partition by i.symbol_id order by far, case when i.kind = 'symbol_conforms_to' then 0 else 1 end, i.edge_id),
    case i.kind when 'symbol_calls_name' then 'called_by_name' when 'symbol_conforms_to' then 'conformed_to_by' else 'incoming_' || i.kind end,
    src.qualified_name, f.path, i.edge_id
  from (select symbol_id, edge_id, min(far) as far, any_value(kind) as kind, any_value(source_symbol_id) as source_symbol_id from (
      select target_symbol_id as symbol_id, edge_id, 0 as far, kind, source_symbol_id from edges where target_symbol_id is not null
      union all select c.symbol_id, e.edge_id, 1, e.kind, e.source_symbol_id from edges e join symbols c on e.target_name = c.qualified_name
      union all select c.symbol_id, e.edge_id, 1, e.kind, e.source_symbol_id from edges e join symbols c on e.target_name = c.name)
    group by symbol_id, edge_id) i
  join symbols src on src.symbol_id = i.source_symbol_id join files f on f.file_id = src.file_id)
where rn <= 5 qualify row_number() over (partition by symbol_id order by side, rn) <= 8"""
ORACLES["neighbours"] = sql("select * from near")

CTE["c_req"] = f"""
select *, case when path_mode = 'filter' and n_hints > 0 then 'path-filter'
    when n_hints > 0 and not (n_terms >= 8 and n_hints <= 2) then 'path-hint-prefilter'
    when n_hints > 0 and n_hints <= 2 and n_terms >= 7 then 'bounded-term-fts' else 'fts' end as plan
from (select *, len(c_terms) as n_terms, coalesce(len(path_hints), 0) as n_hints from (
  select *, {distinct_list(f"list_filter(flatten(list_transform(terms, lambda t: regexp_split_to_array({loose('t')}, '\\s+'))), lambda t: length(t) >= 3)")} as c_terms
  from requests))"""
CTE["c_raw"] = f"""
select distinct query_id, array_to_string({fts('t')}, ' ') as phrase
from (select query_id, unnest(list_filter(regexp_split_to_array(question, '\\s+'), lambda t: length(t) >= 2)) as t from c_req where plan in ('fts', 'path-hint-prefilter'))
where len({fts('t')}) > 0"""
CTE["b_terms"] = f"""
select query_id, array_to_string({fts('t')}, ' ') as phrase from (select query_id, unnest(c_terms[1:10]) as t from c_req where plan = 'bounded-term-fts')
where len({fts('t')}) > 0"""
CTE["c_phrases"] = "select distinct phrase, string_split(phrase, ' ') as ws from (select phrase from c_raw union all select phrase from b_terms)"
CTE["pairs"] = """
select chunk_id, kind, role, dl, a || ' ' || b as phrase, count(*) as f
from (select chunk_id, kind, role, dl, unnest(toks) as a, unnest(list_concat(toks[2:], [''])) as b from tokens)
where a || ' ' || b in (select phrase from c_phrases where len(ws) = 2) group by all"""
CTE["c_hits"] = """
select phrase, chunk_id, kind, role, dl, tf as f from posts join c_phrases on c_phrases.phrase = posts.term
union all
select phrase, chunk_id, kind, role, dl, f from pairs"""
CTE["c_parts"] = weights("c_hits")
CTE["c_ranked"] = f"""
select r.query_id, p.chunk_id, round(sum(w), 9) as rank, r.plan,
  any_value(r.path_hints) as path_hints, any_value(u.path) as path
from c_parts p join c_raw c using (phrase) join c_req r on r.query_id = c.query_id join units u on u.chunk_id = p.chunk_id
where {_HARD.replace(', kind)', ', u.kind)').replace(', role)', ', u.role)').replace('or role =', 'or u.role =')}
group by r.query_id, p.chunk_id, r.plan"""
_SOFT = (
    "len(list_filter(path_hints, lambda h: len(list_filter(regexp_extract_all(lower(h), '[a-z0-9]+'), "
    "lambda t: not contains(lower(path), t))) = 0)) > 0"
)
_TERM = "len(list_filter(c_terms, lambda t: contains(lower(u.text || ' ' || u.qualified_name || ' ' || u.path), t))) > 0"
CTE["c_scan"] = f"""
select r.query_id, u.chunk_id, r.plan, row_number() over (partition by r.query_id order by path, symbol_start, chunk_id) as position
from c_req r join units u on r.plan in ('path-filter', 'bounded-term-fts') and {_SOFT} and {_TERM}
where {_HARD}"""
CTE["b_pool"] = f"""
select query_id, chunk_id, min(rank) as rank from (
  select query_id, chunk_id, rank from (
    select t.query_id, p.chunk_id, round(w, 9) as rank, row_number() over (partition by t.query_id, t.phrase order by round(w, 9), p.chunk_id) as rn
    from b_terms t join c_parts p using (phrase) join c_req r on r.query_id = t.query_id join units u on u.chunk_id = p.chunk_id
    where {_HARD.replace(', kind)', ', u.kind)').replace(', role)', ', u.role)').replace('or role =', 'or u.role =')})
  where rn <= 80
  union all select query_id, chunk_id, 0.0 from c_scan where plan = 'bounded-term-fts' and position <= 160)
group by all"""
CTE["c_rows"] = f"""
select query_id, 1 as attempt, chunk_id, rank, position from (select *, row_number() over (partition by query_id order by rank, chunk_id) as position from c_ranked) where position <= 250
union all
select query_id, 0, chunk_id, rank, position from (select *, row_number() over (partition by query_id order by rank, chunk_id) as position from c_ranked where plan = 'path-hint-prefilter' and {_SOFT}) where position <= 250
union all
select query_id, 1, chunk_id, 0.0, position from c_scan where plan = 'path-filter' and position <= 1000
union all
select query_id, 1, chunk_id, rank, position from (
  select query_id, chunk_id, rank, row_number() over (partition by query_id order by rank, chunk_id) as position
  from b_pool join units using (chunk_id) join c_req using (query_id) where {_HARD}) where position <= 250"""


def _hits(values: str, text: str) -> str:
    return f"len(list_filter({values}, lambda t: contains({text}, t)))"


CTE["c_full"] = f"""
select *, greatest(1.0, -rank * 10) + 8 * {_hits('l_terms', 'l_symbol')} + 4 * {_hits('l_terms', 'l_file')}
  + 2 * {_hits('l_terms', 'l_text')} + 10 * {_hits('l_hints', 'l_file')} as row_score,
  list_filter(c_terms, lambda t: contains(l_file || ' ' || l_symbol || ' ' || l_text, t)) as matched,
  {evidence('text', 'c_terms')} as line,
  length(path || ':' || symbol_start || '-' || symbol_start_end || ' ' || kind || ' ' || qualified_name) + 1 as chars,
  list_sum(list_transform(c_terms, lambda t: case when contains(l_symbol, t) or contains(regexp_replace(l_symbol, '\\s+', '', 'g'), t)
    then 20 + case when regexp_split_to_array(l_symbol, '\\s+')[-1] = t then 90 else 0 end else 0 end)) as name_boost
from (
  select c.query_id, c.attempt, c.chunk_id, c.rank, c.position, r.c_terms, r.plan, r.n_terms, r.n_hints, u.text, u.qualified_name, u.kind, u.symbol_start,
    s.end_line as symbol_start_end, u.path, u.role, u.language, {loose('u.path')} as l_file, {loose('u.qualified_name')} as l_symbol,
    {loose('u.text')} as l_text, list_filter(list_transform(r.terms, lambda t: {loose('t')}), lambda t: t <> '') as l_terms,
    coalesce(list_transform(r.path_hints, lambda h: {loose('h')}), []) as l_hints
  from c_rows c join c_req r using (query_id) join units u using (chunk_id) join symbols s on s.symbol_id = u.chunk_id)"""
CTE["c_symbols"] = """
select query_id, attempt, path,
  array_to_string((list(name order by case when n_hints > 0 then -best end nulls last, case when n_hints > 0 then start_line end nulls last, case when n_hints > 0 then name end nulls last, first_at))[1:12], ',') as symbols
from (
  select query_id, attempt, path, n_hints, qualified_name as name, min(position) as first_at,
    arg_min(symbol_start, position) as start_line, max(row_score + name_boost + 12 * len(matched)) as best
  from c_full group by query_id, attempt, path, n_hints, qualified_name)
group by query_id, attempt, path"""
CTE["c_folded"] = """
select query_id, attempt, path, any_value(role) as role, any_value(language) as language, any_value(plan) as plan,
  any_value(c_terms) as c_terms, any_value(n_terms) as n_terms, max(row_score) as base, count(*) as matched_chunks,
  len(list_distinct(flatten(list(matched)))) as coverage, sum(chars) as symbol_chars,
  (list(line order by row_score desc, position))[1] as evidence
from c_full group by query_id, attempt, path"""
CTE["c_boosted"] = f"""
select *, round(base + least(matched_chunks, 5)
  + case when n_terms >= 2 and coverage >= 2 then least(3 * coverage + case when coverage = n_terms then 4 else 0 end, 16) else 0 end
  + least(6 * {_hits('c_terms', loose("regexp_replace(string_split(path, '/')[-1], '[.][^.]+$', '')"))}, 12), 2) as score,
  symbol_chars + case when evidence <> '' then length(evidence) + 1 else 0 end as context_chars
from c_folded"""
ORACLES["file_clusters"] = sql("""
select query_id, position, path as file, role, language, plan, round(score, 1) as score, matched_chunks, context_chars::bigint as context_chars,
  ceil(context_chars / 4)::bigint as context_tokens, coverage::int as coverage, evidence, symbols
from (
  select b.*, s.symbols, row_number() over (partition by b.query_id order by score desc, matched_chunks desc, b.path) as position
  from c_boosted b join c_symbols s using (query_id, attempt, path)
  where attempt = case when (select count(*) from c_folded f where f.query_id = b.query_id and f.attempt = 0) >= 5 then 0 else 1 end)
where position <= 5""")

CTE["expected"] = """
select distinct b.query_id, f.path
from (select distinct item_id as query_id, unnest(string_split(text, chr(10))) as line from benchmark) b
join (select distinct path, unnest(string_split(text, chr(10))) as line from files) f using (line)"""
ORACLES["retrieval_metrics"] = sql("""
select count(*) as questions, round(avg(case when pos = 1 then 1.0 else 0.0 end), 4) as file_hit_1,
  round(avg(case when pos <= 5 then 1.0 else 0.0 end), 4) as file_hit_5, round(avg(coalesce(1.0 / pos, 0)), 4) as file_mrr,
  round(avg(case when found > 0 and found < wanted then 1.0 else 0.0 end), 4) as partial_files
from (select query_id, count(*) as wanted, min(position) as pos, count(position) as found from (
    select e.query_id, e.path, min(t.position) as position from expected e
    left join (select *, row_number() over (partition by query_id order by fts_position) as position from fts_unique) t
      on t.query_id = e.query_id and t.path = e.path and t.position <= 5
    group by all) group by query_id)""")
CTE["q_terms"] = "select distinct query_id, unnest(list_transform(terms, lambda t: replace(t, '_', ' '))) as term from requests"


def _count(hay: str) -> str:
    return f"((length({hay}) - length(replace({hay}, term, ''))) / length(term))::bigint"


ORACLES["lexical_baseline"] = sql(f"""
select query_id, row_number() over (partition by query_id order by score desc, path) as position, path as file, score
from (select query_id, path, sum({_count('l_text')} + case when contains(l_path, term) then 3 else 0 end)::bigint as score
  from q_terms, (select path, {loose('text')} as l_text, {loose('path')} as l_path from files)
  where contains(l_text, term) or contains(l_path, term) group by all)
qualify row_number() over (partition by query_id order by score desc, path) <= 5""")
ORACLES["line_baseline"] = sql(f"""
select query_id, row_number() over (partition by query_id order by score desc, path) as position, path as file, score, matched_lines
from (select query_id, path, count(*) as score, count(distinct line_no) as matched_lines
  from q_terms, (select f.path, l.line_no, {loose('l.line')} as hay from raw_lines l join files f using (file_id))
  where contains(hay, term) group by all)
qualify row_number() over (partition by query_id order by score desc, path) <= 5""")
CTE["turns"] = f"""
select conv_id as case_id, turn + 1 as step, role, text, ceil(length(text) / 4)::bigint as tokens,
  {distinct_list("list_transform(regexp_extract_all(text, '[\\p{L}]{6,}'), lambda s: lower(s))")} as found from conversations"""
ORACLES["workflow_summary"] = sql("""
select case_id, n_wanted, n_found, complete, commands, total_tokens, first_useful, first_useful_tokens,
  case when complete then last_seen end as completed_at, case when complete then coalesce(tokens_at_last, 0) end as completion_tokens
from (
  select w.case_id, w.n_wanted, coalesce(f.n_found, 0) as n_found, coalesce(f.n_found = w.n_wanted, false) or w.n_wanted = 0 as complete,
    f.first_useful, f.last_seen,
    (select count(*) from turns t where t.case_id = w.case_id and t.step > 1) as cnt,
    case when (select count(*) from turns t where t.case_id = w.case_id and t.step > 1) > 0 then (select count(*) from turns t where t.case_id = w.case_id and t.step > 1) end as commands,
    (select sum(tokens)::bigint from turns t where t.case_id = w.case_id and t.step > 1) as total_tokens,
    (select sum(tokens)::bigint from turns t where t.case_id = w.case_id and t.step > 1 and t.step <= f.first_useful) as first_useful_tokens,
    (select sum(tokens)::bigint from turns t where t.case_id = w.case_id and t.step > 1 and t.step <= f.last_seen) as tokens_at_last
  from (select case_id, len(found) as n_wanted from turns where step = 1) w
  left join (
    select case_id, min(seen) as first_useful, max(seen) as last_seen, count(*) as n_found from (
      select t.case_id, v.value, min(t.step) as seen
      from (select case_id, step, unnest(found) as value from turns where step > 1) t
      join (select case_id, unnest(found) as value from turns where step = 1) v using (case_id, value) group by all)
    group by case_id) f using (case_id))""")
ORACLES["mention_rates"] = sql("""
select e.case_id, count(*) as expected, count(*) filter (contains(lower(a.text), lower(e.value))) as mentioned,
  round(count(*) filter (contains(lower(a.text), lower(e.value))) / count(*), 4) as rate
from (select case_id, unnest(found) as value from turns where step = 1) e
left join (select case_id, string_agg(text, ' ' order by step) as text from turns where role = 'assistant' group by 1) a using (case_id)
group by 1""")
ORACLES["leaked_targets"] = sql("""
select case_id, stem as leaked
from (select distinct query_id as case_id, regexp_replace(string_split(path, '/')[-1], '[.][^.]+$', '') as stem from expected) e
join requests r on r.query_id = e.case_id
where length(regexp_replace(lower(stem), '[^a-z0-9]+', '', 'g')) > 0 and
  len(list_filter(terms, lambda q: contains(regexp_replace(lower(q), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(stem), '[^a-z0-9]+', '', 'g')))) > 0""")
ORACLES["run_spread"] = """
select event_type, min(value) as low, max(case when rn = n // 2 + 1 then value end) as median, max(value) as high,
  count(*) as runs, round(max(value) - min(value), 4) as spread
from (select event_type, value, row_number() over (partition by event_type order by value) as rn,
  count(*) over (partition by event_type) as n from events where value is not null) group by 1"""


def _runs(kind: str) -> str:
    return (
        "(select user_id, count(*) as cases, round(avg(value), 6) as quality, max(value) as tokens "
        f"from events where event_type = '{kind}' group by 1)"
    )


ORACLES["suite_weighted_means"] = f"""
select sum(cases)::bigint as cases, round(sum(quality * cases) / sum(cases), 4) as quality, round(sum(tokens * cases) / sum(cases), 4) as tokens
from {_runs('view')}"""
ORACLES["artifact_regressions"] = f"""
with j as (select b.*, c.user_id as present, c.cases as c_cases, c.quality as c_quality, c.tokens as c_tokens
  from {_runs('view')} b left join {_runs('click')} c using (user_id))
select user_id, 'missing' as metric, null::double as before, null::double as after from j where present is null
union all select user_id, 'cases', cases::double, c_cases::double from j where c_cases < cases
union all select user_id, 'quality', quality, c_quality from j where c_quality < quality
union all select user_id, 'tokens', tokens, c_tokens from j where c_tokens > tokens * 1.1"""
ORACLES["condition_summary"] = """
with r as (select event_type as condition, value, (props->>'$.k')::int as k from events),
m as (select condition, 'mode_' || (k % 7) as mode, count(*) as n from r where value < 5 group by all),
t as (select condition, string_agg(mode || ':' || n, ',' order by n desc, mode) as failures from m group by 1),
d as (select condition, max(case when rn = n // 2 + 1 then k end) as median_tokens from (
  select condition, k, row_number() over (partition by condition order by k) as rn, count(*) over (partition by condition) as n from r where k is not null) group by 1)
select condition, count(*) as reviews, count(*) filter (value >= 20) as passed, count(*) filter (value >= 5 and value < 20) as partial,
  count(*) filter (not (value >= 5) or value is null) as failed, round(avg(k % 6), 4) as mean_quality,
  any_value(median_tokens) as median_tokens, any_value(t.failures) as failures
from r left join d using (condition) left join t using (condition) group by 1"""
ORACLES["trace_report"] = """
select user_id as session, count(*) as events, count(*) filter (event_type = 'view') as queries, count(*) filter (event_type = 'error') as fallbacks,
  count(*) filter (event_type = 'purchase') as changes, count(*) filter (event_type = 'signup') as verifications,
  count(*) filter (event_type not in ('view', 'error', 'purchase', 'signup')) as lessons, count(*) filter (value >= 10) as useful,
  max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as duration_ms, min(case when value >= 10 then epoch_us(ts) // 1000 end) - min(epoch_us(ts) // 1000) as first_useful_ms
from events group by 1"""
ORACLES["evidence_lines"] = f"""
select doc_id, {evidence('text', 'ts')} as evidence
from (select doc_id, text, {distinct_list("list_transform(regexp_extract_all(string_split(text, chr(10))[-1], '[A-Za-z]{5,}'), lambda s: lower(s))")} as ts from documents)"""
ORACLES["text_kernels"] = f"""
select conv_id, turn, {strict('text')} as strict, {loose('text')} as loose,
  lower(trim(regexp_replace(translate(text, '\\/', '..'), '[^A-Za-z0-9_.]+', ' ', 'g'))) as dotted,
  regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as target,
  array_to_string(list_filter({distinct_list(f"flatten(list_transform(list_filter(string_split({strict('text')}, ' '), lambda t: length(t) >= 2), lambda t: [t, {stem('t')}]))")}, lambda t: length(t) >= 2), ' ') as ranked,
  array_to_string({fts('text')}, ' ') as fts, ceil(length(text) / 4)::bigint as tokens
from conversations"""

CTE["code_rest"] = """
select file_id, translate(coalesce(string_agg(line, ' ' order by line_no), ''), '(', '[') as rest from raw_lines
where len(regexp_extract_all(line, '[A-Za-z]{2,}')) < 2 group by 1"""
CTE["code_lines"] = """
select l.file_id, l.ws, translate(l.line, '(', '[') as line, row_number() over (partition by l.file_id order by l.line_no) - 1 as i, d.ending = '.py' as py
from lines l join docs d using (file_id)"""
CTE["code_methods"] = """
select file_id, py, i, line, 'm' || i || '_' || lower(ws[1]) || '_' || lower(ws[2]) as name, 'call_' || lower(ws[-1]) as called,
  case when py then 4 + 3 * i else 4 + 4 * i end as start_line, case when py then 5 + 3 * i else 6 + 4 * i end as end_line
from code_lines"""
CTE["code_heads"] = f"""
select file_id, py, {camel('ws[1]')} || {camel('ws[2]')} as head, n,
  regexp_replace(path, '\\.[a-z]+$', case when py then '.py' else '.kt' end) as path,
  case when py then 3 + 3 * n else 3 + 4 * n end as last_line
from code_lines join (select file_id, count(*) as n from code_lines group by 1) using (file_id) join files using (file_id) where i = 0"""
CTE["code_bare"] = """
select file_id, regexp_replace(path, '\\.[a-z]+$', case when ending = '.py' then '.py' else '.kt' end) as path,
  case when ending = '.py' then 'import os  # ' else 'import os  // ' end || coalesce(rest, '') || chr(10) as text
from files join docs using (file_id) left join code_rest using (file_id)
where file_id not in (select file_id from code_lines)"""
CTE["code_symbols"] = """
select file_id, file_id * 16777216 as symbol_id, path as name, path as qualified_name, 'module' as kind, 1 as start_line, 2 as end_line,
  null::bigint as parent_symbol_id from code_bare
union all
select file_id, file_id * 16777216 as symbol_id, path as name, path as qualified_name, 'module' as kind, 1 as start_line,
  case when py then last_line else last_line + 1 end as end_line, null::bigint as parent_symbol_id from code_heads
union all
select file_id, file_id * 16777216 + 1, head, head, 'class', 3, case when py then last_line - 1 else last_line end, file_id * 16777216 from code_heads
union all
select m.file_id, m.file_id * 16777216 + 2 + i, m.name, head || '.' || m.name, 'method', start_line, end_line, m.file_id * 16777216 + 1
from code_methods m join code_heads h using (file_id)"""
ORACLES["extract_symbols"] = sql(
    "select file_id, symbol_id, name, qualified_name, kind, start_line::int as start_line, end_line::int as end_line, parent_symbol_id from code_symbols"
)
CTE["code_edges"] = """
select file_id, file_id * 16777216 as source_symbol_id, file_id * 16777216 + 1 as target_symbol_id, head as target_name,
  'file_contains_symbol' as kind, 'exact' as confidence, 0 as sort, 3 as line_no from code_heads
union all
select m.file_id, m.file_id * 16777216 + 1, m.file_id * 16777216 + 2 + i, head || '.' || m.name, 'symbol_contains_symbol', 'exact', 0, start_line
from code_methods m join code_heads using (file_id)
union all
select file_id, file_id * 16777216, null, 'os', 'symbol_imports_module', 'name', 1, 1 from code_heads
union all
select file_id, file_id * 16777216, null, 'os', 'symbol_imports_module', 'name', 1, 1 from code_bare
union all
select file_id, file_id * 16777216 + 1, null, 'Base' || file_id, 'symbol_conforms_to', 'name', 2, 3 from code_heads
union all
select file_id, file_id * 16777216 + 2 + i, null, called, 'symbol_calls_name', 'name', 3, start_line from code_methods"""
ORACLES["extract_edges"] = sql("""
select file_id * 16777216 + row_number() over (partition by file_id order by sort, line_no) as edge_id,
  source_symbol_id, target_symbol_id, target_name, kind, confidence from code_edges""")
CTE["code_texts"] = """
select file_id, head, py,
  case when py then 'import os  # ' || rest || chr(10) || chr(10) || 'class ' || head || '(Base' || file_id || '):' || chr(10) || body
  else 'import os  // ' || rest || chr(10) || chr(10) || 'class ' || head || ' : Base' || file_id || ' {' || chr(10) || body || '}' || chr(10) end as text
from (select h.*, coalesce(c.rest, '') as rest from code_heads h left join code_rest c using (file_id)) join (
  select file_id, string_agg(case when py then '    def ' || name || '(self):  # ' || line || chr(10) || '        return ' || called || '(1)' || chr(10)
    else '    fun ' || name || '() {  // ' || line || chr(10) || '        ' || called || '(1)' || chr(10) || '    }' || chr(10) end, chr(10) order by i) as body
  from code_methods group by 1) using (file_id)"""
ORACLES["extract_chunks"] = sql("""
select s.symbol_id as chunk_id, s.symbol_id, s.start_line::int as start_line, s.end_line::int as end_line,
  sha256(case when s.kind = 'module' then t.text else array_to_string(string_split(t.text, chr(10))[s.start_line:s.end_line], chr(10)) end) as hash
from code_symbols s join (select file_id, text from code_texts union all select file_id, text from code_bare) t using (file_id)""")


# file heads, lines of a method, its first and last line, and lines behind the methods of the code around each text line
ORACLES["extract_statements"] = """
with shape(k, ending, head, size, first, last, tail) as (
  values (0, 'py', 3, 11, 1, 10, 0), (1, 'java', 3, 12, 4, 11, 1), (2, 'ts', 3, 12, 4, 11, 1), (3, 'go', 4, 12, 4, 11, 0), (4, 'rs', 4, 12, 4, 11, 1)
), d as (
  select doc_id as file_id, string_split(coalesce(text, ''), chr(10)) as ls, 'C' || doc_id as c, s.*,
    doc_id * 16777216 as base, 'src/C' || doc_id || '.' || ending as path
  from documents join shape s on ((doc_id % 5) + 5) % 5 = s.k
), m as (select *, unnest(ls) as line, unnest(range(len(ls))) as i from d)
select file_id, base as symbol_id, path as name, path as qualified_name, 'module' as kind, 1 as start_line,
  (head + size * len(ls) + tail + 1)::int as end_line, null::bigint as parent_symbol_id from d
union all
select file_id, base + 1, c, c, 'class', case when k = 4 then 2 else 3 end,
  (case when k = 0 then 2 + size * len(ls) when k in (1, 2) then head + size * len(ls) + 1 when k = 3 then 4 else 3 end)::int, base from d
union all
select file_id, base + 2 + i, name, c || '.' || name, 'method', (head + size * i + first)::int, (head + size * i + last)::int, base + 1
from (select *, 'm' || i || case when regexp_extract(line, '[A-Za-z]+') = '' then '' else '_' || lower(regexp_extract(line, '[A-Za-z]+')) end as name from m)
"""

_WANTED = "not list_contains(coalesce(roles, []), 'test')"
_LITERALS = [r for r in LITERAL_RULES if r.seeds]
CTE["seed_list"] = f"""
select query_id, unnest(seeds) as seed, unnest(range(0, len(seeds))) as place
from (select query_id, {fs.once('every_')} as seeds from (
  select query_id, flatten([case when {fs.ENTRY} then {fs.listed(ENTRY_SEEDS)} else [] end,
    list_filter(list_transform(refs, lambda r: lower(split_part(r, '.', -1))), lambda m: length(m) >= 3),
    {', '.join(f"case when {fs.gate(r)} then {fs.listed(r.seeds)} else [] end" for r in _LITERALS)}]) as every_
  from (select r.*, q_tokens, {strict('question')} as q_norm,
    regexp_extract_all(question, '\\b([A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z_][A-Za-z0-9_]*)\\b', 1) as refs
    from requests r join ranked using (query_id) where {_WANTED})))"""
CTE["seed_top"] = f"""
select query_id, chunk_id, place from (
  select s.query_id, s.place, u.chunk_id, row_number() over (
    partition by s.query_id, s.place order by case when lower(u.name) = s.seed then 0 else 1 end, u.path, u.symbol_start, u.chunk_id) as rn
  from seed_list s join requests r on r.query_id = s.query_id
  join units u on lower(u.name) = s.seed or lower(u.qualified_name) like '%' || s.seed || '%' or lower(u.path) like '%' || s.seed || '%'
  where s.place < 12 and {_HARD.replace(', kind)', ', u.kind)').replace(', role)', ', u.role)').replace('or role =', 'or u.role =')} and {_ALLOWED})
where rn <= 120"""
CTE["pool_i"] = """
select query_id, chunk_id, rank, position from (
  select *, row_number() over (partition by query_id order by source_rank, rank, path, symbol_start, chunk_id) as position
  from (
    select query_id, chunk_id, min(rank) as rank, min(source_rank) as source_rank from (
      select query_id, chunk_id, rank, place as source_rank from pool_words join word_top using (query_id, word)
      union all
      select query_id, chunk_id, 0.0, coalesce(n, 0) + place from seed_top left join (select query_id, count(*) as n from pool_words group by 1) using (query_id))
    group by all)
  join units using (chunk_id))
where position <= 300"""
CTE["i_rows"] = f"""
select p.query_id, p.chunk_id, p.rank, p.position as pool_position, u.name, u.qualified_name, u.kind, u.path, u.role, u.text, r.question
from pool_i p join units u on u.chunk_id = p.chunk_id join requests r on r.query_id = p.query_id where u.kind <> 'module' and {_WANTED}"""
CTE["i_ready"] = fs.prepared("i_rows")
CTE["i_boost"] = fs.boosted("i_ready")
CTE["i_top"] = """
select * from (select query_id, chunk_id, rank, boost, reasons, row_number() over (partition by query_id order by boost desc, pool_position) as position from i_boost)
where position <= 12 and boost > 0"""
CTE["m_all"] = f"""
select query_id, chunk_id, max(boost) as boost, min(fts_position) as fts_position, min(source * 1000 + position) as first_place,
  {fs.once('any_value(said)')} as reasons
from (
  select *, flatten(list(reasons) over (partition by query_id, chunk_id order by source rows between unbounded preceding and unbounded following)) as said
  from (
    select query_id, chunk_id, 0 as source, position, null as fts_position, 42.0 as boost, ['exact symbol term match'] as reasons from exact_top
    union all select query_id, chunk_id, 1, position, null, 0.0, []::varchar[] from hint_top
    union all select query_id, chunk_id, 2, position, null, boost, reasons from i_top
    union all select query_id, chunk_id, 3, fts_position, fts_position, 0.0, []::varchar[] from fts_top))
group by query_id, chunk_id"""
CTE["near_count"] = "select symbol_id, count(*) as n from near group by 1"
CTE["s_rows"] = """
select m.*, u.name, u.qualified_name, u.kind, u.path, u.role, u.text, u.symbol_start, s.end_line as symbol_end, r.question, r.path_hints,
  case when r.expand is null or len(r.expand) > 0 then coalesce(c.n, 0) else 0 end as near_n,
  (r.expand is null or len(r.expand) > 0) and c.n is not null as has_neighbours
from m_all m join units u on u.chunk_id = m.chunk_id join symbols s on s.symbol_id = u.symbol_id join requests r on r.query_id = m.query_id
left join near_count c on c.symbol_id = u.symbol_id"""
CTE["s_ready"] = fs.prepared("s_rows")
CTE["s_done"] = fs.scored("s_ready")
_LEAF = "split_part(qualified_name, '.', -1)"
_SAID = lambda r: f"list_contains(why, '{r}')"
CTE["s_placed"] = f"""
select *, round(score
  + case when early and kind = 'function' then 4 when early and kind = 'method' and not odd and (named or {_SAID('method owner/source match')}) then 4 else 0 end
  + case when kind = 'function' and {_SAID('exact symbol name match')} and {_SAID('symbol token coverage match')} then 3
      when kind = 'method' and meant and list_contains(leaf_words, 'call') then 14 when kind = 'method' and meant and named then 8
      when kind = 'method' and meant then 4 when kind = 'method' and {_SAID('method owner/name match')} then 2
      when kind = 'method' and coalesce(fts_position <= 2, false) and not odd and len(leaf_words) = 1 and {_SAID('method name match')} then 3 else 0 end
  + case when kind = 'module' then -18 when kind = 'class' and ({_SAID('symbol token coverage match')} or meant) and not {_SAID('exact class name match')} then -12 else 0 end,
  3) as moved
from (
  select *, coalesce(fts_position <= 5, false) as early, kind = 'method' and starts_with({_LEAF}, '__') and ends_with({_LEAF}, '__') as odd,
    {fs.words(strict(_LEAF))} as leaf_words, {fs.some('why', 'r', "contains(r, 'intent')")} as meant,
    {_SAID('method name match')} or {_SAID('method owner/name match')} as named
  from s_done)"""


def _found(adjusted: str) -> str:
    order = f"{adjusted} desc, first_place, chunk_id"
    return sql(f"""
select query_id, position, qualified_name as symbol, kind, path as file, symbol_start::int as start_line, symbol_end::int as end_line, score,
  {adjusted} as adjusted, array_to_string(why, '; ') as why, {evidence('text', 'q_tokens')} as evidence, near_n::int as neighbours
from (
  select *, row_number() over (partition by query_id order by {order}) as position
  from (select *, row_number() over (partition by query_id, path, qualified_name order by {order}) as nth from s_placed) where nth = 1)
where position <= 5""")


ORACLES["search_symbol"] = _found("score")
ORACLES["search_hybrid"] = _found("moved")
ORACLES["match_features"] = fs.match_features()


def dotted(x: str) -> str:
    return f"lower(trim(regexp_replace(translate({x}, '\\/', '..'), '[^A-Za-z0-9_.]+', ' ', 'g')))"


_STOP = fs.in_list(related.LAYOUT_STOPWORDS)
_TEXT = "string_split_regex({0}, '\\s+')"


def _parts(x: str) -> str:
    return _TEXT.format(x)


def _variants(m: str) -> str:
    plain = f"regexp_replace({m}, '\\.(?:cjs|mjs|jsx?|tsx?|dart|[ch])$', '')"
    index = f"regexp_replace({plain}, '/index$', '')"
    forms = [plain, index, f"regexp_replace({plain}, '^(?:src|lib)/', '')", f"regexp_replace({index}, '^(?:src|lib)/', '')"]
    return "[" + ", ".join(dotted(f) for f in (m, *forms)) + "]"


# what is asked: source_id, source_file, symbol (null without one), terms, wanted
CTE["t_sources"] = f"""
select f.file_id as source_id, f.path as source_file, s.qualified_name as symbol, 5 as wanted,
  {distinct_list("list_transform(regexp_extract_all(f.text, '[A-Za-z]{11,}'), lambda t: lower(t))")} as terms
from files f left join (select file_id, arg_min(qualified_name, symbol_id) as qualified_name from members where kind = 'function' group by 1) s using (file_id)
where f.role = 'source'"""


def related_ctes(prefix: str, source: str) -> dict[str, str]:
    """Tests of the requests in ``source``; every request meets every test, and what shows no signal is left out."""
    base = "regexp_replace(regexp_replace(source_file, '\\.[^./]+$', ''), '/__init__$', '')"
    ext = "split_part(source_file, '.', -1)"
    folder = lambda x: f"case when contains({x}, '/') then regexp_replace({x}, '/[^/]*$', '') else '' end"
    rust = f"regexp_extract({base}, '^(?:[^/]+/)*?src/(.+)$', 1)"
    jvm = f"regexp_extract({base}, '^(?:[^/]+/)*?src/[^/]+/(?:kotlin|java)/(.+)$', 1)"
    modules = (
        f"flatten([[{base}], case when {ext} = 'go' then [{folder(base)}] else [] end, "
        f"case when {ext} = 'rs' then [{rust}, regexp_replace({rust}, '(?:^|/)(?:mod|lib|main)$', '')] else [] end, "
        f"case when {ext} in ('kt', 'kts') then [{jvm}, {folder(jvm)}] else [] end, "
        f"case when ends_with({base}, '/index') then [regexp_replace({base}, '/index$', '')] else [] end, "
        f"case when regexp_matches({base}, '^(?:src|lib)/') then [regexp_replace({base}, '^(?:src|lib)/', '')] else [] end])"
    )
    leaf = loose("list_filter(string_split_regex(symbol, '[^A-Za-z0-9_]+'), lambda p: p <> '')[-1]")
    dot_leaf = loose("split_part(symbol, '.', -1)")
    owner = "case when contains(symbol, '.') then regexp_replace(symbol, '\\.[^.]*$', '') else symbol end"
    verbs = fs.in_list(related.NOUN_VERBS)
    words = f"flatten(list_transform(terms, lambda t: {_parts(loose('t'))}))"
    once, some, number = fs.once, fs.some, fs.number
    out = {}
    out["a"] = f"""
select *, {loose("regexp_replace(split_part(source_file, '/', -1), '\\.[^.]+$', '')")} as stem, {leaf} as leaf, {dot_leaf} as dot_leaf,
  list_filter({_parts(loose('source_file'))}, lambda t: t <> '') as s_tokens, {words} as words, {loose('symbol')} as l_symbol,
  string_split_regex({owner}, '::|\\.')[-1] as class_name, list_filter(list_transform(terms, lambda t: {loose('t')}), lambda t: length(t) >= 2) as l_terms,
  list_filter({_parts(loose("regexp_replace(source_file, '\\.[^.]+$', '')"))}, lambda t: length(t) >= 3 and t not in {_STOP}) as layout_,
  list_filter(list_transform({modules}, lambda n: {dotted('n')}), lambda n: n <> '') as modules_
from {source}"""
    out["b"] = f"""
select *, {once('modules_')} as modules, {once('layout_')} as layout,
  {once(f"list_filter(words, lambda t: length(t) >= 4 and t not in {_STOP})")} as path_terms,
  ({once(f"list_filter(words, lambda t: length(t) >= 5 and t not in {_STOP})")})[1:3] as task_terms,
  case when regexp_matches(class_name, '^[A-Z]') then {loose('class_name')} end as l_class,
  {once(f"list_filter([stem, dot_leaf, case when contains(dot_leaf, ' ') and split_part(dot_leaf, ' ', 1) in {verbs} then regexp_replace(dot_leaf, '^[^ ]+ +', '') end], lambda n: length(n) >= 3)")} as fixture_names,
  {once(f"list_filter(s_tokens, lambda t: length(t) >= 3 and t not in {_STOP} and t not in {fs.in_list(related.GENERIC_PATH_WORDS)})")} as candidate
from {prefix}a"""
    out["c"] = f"""
select *, {once("list_filter(list_concat([stem], candidate[2:]), lambda t: length(t) >= 3)")} as cand_tokens,
  list_transform(modules, lambda m: replace(m, '.', '')) as flat_modules
from {prefix}b"""
    mirrored = "len(list_intersect(layout, test_layout))"
    shared = number("s_tokens", "t", f"length(t) >= 3 and t not in {_STOP} and contains(t_path, t)")
    body = number("l_terms", "t", "contains(t_text, t)")
    parent = "regexp_replace(m, '\\.[^.]*$', '')"
    imports = some("modules", "m", some("t_imports", "i", "i = m or starts_with(i, m || '.') or ends_with(i, '.' || m)")
                   + f" or (contains(m, '.') and list_contains(t_imports, {parent}) and contains(t_text, stem))")
    signals = [
        ("test path includes source stem", "case when contains(t_path, stem) then 20 else 0 end"),
        ("test path matches task terms", f"least(8 * {number('path_terms', 't', 'contains(t_path, t)')}, 32)"),
        ("test path shares source path tokens", f"least(4 * {shared}, 16)"),
        ("test path mirrors source package layout", f"case when {mirrored} > 0 then least(10 + 6 * {mirrored}, 22) else 0 end"),
        ("test imports source module", f"case when {imports} then 30 else 0 end"),
        ("test uses related fixture", f"case when {some('fixture_names', 'n', 'contains(t_text, n)')} and list_has_any(t_fixtures, fixture_names) then 18 else 0 end"),
        ("test body matches task terms", f"least(12 * {body}, 84)"),
        ("strong task-term coverage", f"case when {body} >= 5 then 24 else 0 end"),
        ("RSpec describes source symbol", "case when symbol is not null and coalesce(contains(t_text, l_class), false) then 32 else 0 end"),
        ("request spec exercises Rails route", """case when symbol is not null and regexp_matches(path, '^spec/requests/.*_spec\\.rb$') and regexp_matches(t_text, 'get|post|put|patch|delete')
           and (contains(t_text, regexp_replace(stem, '\\s*controller$', '') || ' path') or contains(t_text, regexp_replace(stem, '\\s*controller$', '') || ' url')
             or contains(t_text, leaf)) then 28 else 0 end"""),
        ("test body mentions source symbol", "case when symbol is not null and (contains(t_text, l_symbol) or contains(t_text, leaf)) then 24 else 0 end"),
        ("test calls source symbol", "case when symbol is not null and list_contains(t_calls, leaf) then 28 else 0 end"),
        ("test path includes symbol name", "case when symbol is not null and contains(t_path, leaf) then 36 else 0 end"),
    ]
    basic = (
        f"({some('cand_tokens', 't', 'contains(low_path, t)')} or {some('flat_imports', 'i', some('flat_modules', 'm', 'contains(i, m)'))} "
        "or coalesce(low_path like '%' || replace(leaf, ' ', '%') || '%', false) or coalesce(list_contains(edge_calls, leaf), false))"
    )
    tokens = f"contains(t_tokens, ' ' || array_to_string({fts('t')}, ' ') || ' ')"
    out["d"] = f"""
select *, {', '.join(f'{points} as s{i}' for i, (_, points) in enumerate(signals))},
  {basic} or (len(task_terms) > 0 and {fs.every('task_terms', 't', tokens)}) as fast,
  {basic} or (len(task_terms) > 0 and {fs.every('task_terms', 't', 'contains(low_text, t)')}) as slow
from {prefix}c, t_tests"""
    reasons = ", ".join(f"case when s{i} > 0 then ['{reason}'] else [] end" for i, (reason, _) in enumerate(signals))
    out["e"] = f"""
select *, flatten([{reasons}, case when regexp_matches(path, '^(?:tests?|integration_tests?|functional_tests?|acceptance_tests?)/') then ['external test root'] else [] end]) as why,
  raw + case when regexp_matches(path, '^(?:tests?|integration_tests?|functional_tests?|acceptance_tests?)/') then 24 else 0 end as score
from (select *, {' + '.join(f's{i}' for i in range(len(signals)))} as raw from {prefix}d)"""
    out["f"] = f"""
select source_id, count(*) filter (fast) as n_fast, count(*) filter (fast and raw > 0) as m_fast, count(*) filter (slow and raw > 0) as m_slow
from {prefix}e group by 1"""
    slow = "(len(task_terms) > 0 and n_fast < wanted)"
    plain, ours = loose("x"), dotted("x")
    useful = (
        f"contains({plain}, stem) or {some('modules', 'm', f'contains({ours}, m)')} or coalesce(contains({plain}, leaf), false) "
        f"or {some('l_terms', 't', f'contains({plain}, t)')} or {some('t_fixtures', 'g', f'list_contains(fixture_names, g) and contains({plain}, g)')}"
    )
    out["g"] = f"""
select source_id, file_id, path, score, why, position, nullif(coalesce(list_position(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {useful}), true), 0), 0) as first_line
from (
  select *, row_number() over (partition by source_id order by score desc, translate(path, '_', '!')) as position
  from {prefix}e join {prefix}f using (source_id)
  where raw > 0 and (not (case when {slow} then m_slow else m_fast end >= wanted) or case when {slow} then slow else fast end))
where position <= wanted"""
    return {prefix + k: v for k, v in out.items()}


# tests with their derived columns; no text of the given tables parametrises a test
_USED = "flatten(list_transform(regexp_extract_all(text, '(?m)^\\s*use\\s+([^;]+);', 1), lambda u: string_split_regex(trim(regexp_replace(u, '[{},]+', ' ', 'g')), '\\s+')))"
CTE["t_linked"] = """
select s.file_id, list(distinct trim(e.target_name)) filter (e.kind = 'symbol_imports_module') as imports,
  list(distinct trim(e.target_name)) filter (e.kind = 'symbol_calls_name') as calls
from edges e join symbols s on s.symbol_id = e.source_symbol_id group by 1"""
CTE["t_base"] = f"""
select f.file_id, f.path, f.text, {loose('f.path')} as t_path, lower(f.path) as low_path, {loose('f.text')} as t_text,
  translate(f.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low_text, ' ' || array_to_string(t.toks, ' ') || ' ' as t_tokens,
  coalesce(l.imports, []) as imports, coalesce(l.calls, []) as calls,
  case when contains(f.text, 'use ') then list_filter(list_transform({_USED.replace('text', 'f.text')}, lambda p: {dotted("replace(p, '::', '.')")}), lambda p: p <> '') else [] end as used
from files f join tokens t on t.chunk_id = f.file_id * 16777216 left join t_linked l using (file_id) where f.role = 'test'"""
_BARE = "regexp_replace(p, '^(?:crate|self|super)\\.', '')"
CTE["t_tests"] = f"""
select *, list_transform(imports, lambda m: replace(lower(m), '.', '')) as flat_imports, list_transform(calls, lambda m: lower(m)) as edge_calls,
  list_filter(list_concat(flatten(list_transform(imports, lambda m: {_variants('m')})), used, list_transform(used, lambda p: {_BARE}),
    list_transform(used, lambda p: case when contains({_BARE}, '.') then regexp_replace({_BARE}, '\\.[^.]*$', '') else '' end)), lambda p: p <> '') as t_imports,
  list_concat(list_transform(calls, lambda m: {loose('m')}),
    list_transform(regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*(?:::<[^>]+>\\s*)?\\(', 1), lambda m: {loose('m')})) as t_calls,
  list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '\\bdef\\s+test[\\w_]*\\s*\\(([^)]*)\\)', 1), lambda a: string_split(a, ','))),
    lambda a: {loose("regexp_replace(regexp_replace(regexp_replace(trim(a), '^[*/]+', ''), '\\s*=.*$', ''), '\\s*:.*$', '')")}), lambda n: n not in ('', 'self', 'cls')) as t_fixtures,
  list_filter({_parts(loose("regexp_replace(path, '\\.[^.]+$', '')"))}, lambda t: length(t) >= 3 and t not in {_STOP}) as test_layout
from t_base"""
CTE.update(related_ctes("r_", "t_sources"))
ORACLES["related_tests"] = sql("""
select source_id, position, path as file, score, array_to_string(why, '; ') as why, first_line from r_g""")

CTE["b_symbols"] = """
select query_id, attempt, path,
  (list(struct_pack(name := name, kind := kind, start_line := start_line)
    order by case when n_hints > 0 then -best end nulls last, case when n_hints > 0 then start_line end nulls last, case when n_hints > 0 then name end nulls last, first_at))[1:12] as symbols
from (
  select query_id, attempt, path, n_hints, qualified_name as name, min(position) as first_at, arg_min(kind, position) as kind,
    arg_min(symbol_start, position) as start_line, max(row_score + name_boost + 12 * len(matched)) as best
  from c_full group by query_id, attempt, path, n_hints, qualified_name)
group by query_id, attempt, path"""
CTE["b_found"] = """
select query_id, path, score, symbols, place from (
  select b.*, s.symbols, row_number() over (partition by b.query_id order by score desc, matched_chunks desc, b.path) as place
  from c_boosted b join b_symbols s using (query_id, attempt, path)
  where attempt = case when (select count(*) from c_folded f where f.query_id = b.query_id and f.attempt = 0) >= 5 then 0 else 1 end)
where place <= 5"""
_S_WHOLE, _S_LEAF = strict("s.name"), strict("split_part(s.name, '.', -1)")
CTE["q_sources"] = f"""
select query_id * 100 + place as source_id, path as source_file, 2 as wanted, terms,
  (list_sort(list_transform(symbols, lambda s, i: struct_pack(o := -(case when s.kind in ('method', 'function') then 6 else 0 end
    + coalesce(list_sum(list_transform(ws, lambda t: case when {_S_LEAF} = t then 24 when contains({_S_LEAF}, t) then 16
        when contains({_S_WHOLE}, t) or contains(replace({_S_WHOLE}, ' ', ''), t) then 8 else 0 end)), 0)), i := i, name := s.name))))[1].name as symbol
from (select f.*, r.terms, list_filter(flatten(list_transform(r.terms, lambda t: string_split({strict('t')}, ' '))), lambda t: length(t) >= 3) as ws
  from b_found f join requests r using (query_id) where place <= 3)"""
CTE.update(related_ctes("q_", "q_sources"))
_TOLD = "case when first_line is null then path else path || ':' || first_line end"
CTE["b_tests"] = f"""
select source_id, list(path order by position) as tests, list({_TOLD} order by position) as told, arg_min(score, position) as best, arg_min(why, position) as why
from q_g group by 1"""
_BONUS = " + ".join(f"case when list_contains(why, '{reason}') then {points} else 0 end" for reason, points in source_tests.PAIR_BONUS.items())
ORACLES["source_tests"] = sql(f"""
select query_id, row_number() over (partition by query_id order by bundle_score desc, translate(path, '_', '!')) as position, path as file, bundle_score,
  ceil(length(array_to_string(list_concat([path || ':' || symbols[1].start_line], coalesce(told, [])), ' -> ')) / 4)::bigint as context_tokens,
  array_to_string(tests, ',') as tests, array_to_string(why, '; ') as test_why
from (
  select f.*, t.*, round(f.score + coalesce(t.best / 10, 0.0) + {_BONUS}, 3) as bundle_score
  from b_found f left join b_tests t on t.source_id = f.query_id * 100 + f.place)""")

CTE.update(navigation_sql.CTE)
ORACLES.update({name: sql(body) for name, body in navigation_sql.BODIES.items()})
