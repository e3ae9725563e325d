"""Score features and intent rules as SQL for DuckDB, written from their meaning; only word lists are shared."""

from __future__ import annotations

from codelode.functions import features as ft
from codelode.functions import intent as it
from codelode.functions import text as tx
from codelode.workload.cases import CASES, FIELDS, SPARE_WORDS


def strict(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def stem(t: str) -> str:
    return (
        f"case when {t} like '%ing' and length({t}) > 5 then left({t}, length({t}) - 3) "
        f"when {t} like '%ed' and length({t}) > 4 then left({t}, length({t}) - 2) "
        f"when {t} like '%s' and length({t}) > 3 then left({t}, length({t}) - 1) else {t} end"
    )


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::varchar[]"


def words(x: str, least: int = 1) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w_: length(w_) >= {least})"


def once(l: str) -> str:
    """The list without later repeats."""
    return f"list_filter({l}, lambda x_, i_: list_position({l}, x_) = i_)"


def has(vocabulary, tokens: str = "q_tokens") -> str:
    return f"list_has_any({tokens}, {listed(vocabulary)})"


def some(l: str, var: str, test: str) -> str:
    return f"(len(list_filter({l}, lambda {var}: {test})) > 0)"


def every(l: str, var: str, test: str) -> str:
    return f"(len(list_filter({l}, lambda {var}: not ({test}))) = 0)"


def number(l: str, var: str, test: str) -> str:
    return f"len(list_filter({l}, lambda {var}: {test}))"


def _pairs(a: str, b: str, pairs) -> str:
    return " or ".join(f"({a} = '{x}' and {b} = '{y}') or ({a} = '{y}' and {b} = '{x}')" for x, y in pairs)


def alike(a: str, b: str) -> str:
    return (
        f"({a} = {b} or ({stem(a)}) = ({stem(b)}) or {_pairs(a, b, tx.LOOSE_SYNONYMS)} "
        f"or (length({a}) >= 5 and length({b}) >= 5 and left({a}, 5) = left({b}, 5)))"
    )


def among(l: str, word: str, var: str = "y") -> str:
    return some(l, var, alike(var, word))


def in_order(name: str, tokens: str = "q_tokens") -> str:
    same = (
        f"({name}[a_.i + 1] = b_.t or ({stem(f'{name}[a_.i + 1]')}) = ({stem('b_.t')}) or {_pairs(f'{name}[a_.i + 1]', 'b_.t', tx.ORDER_SYNONYMS)} "
        f"or ({name}[a_.i + 1] in {in_list(tx.PARAMETER_WORDS)} and b_.t in {in_list(tx.PARAMETER_WORDS)}))"
    )
    return (
        f"coalesce((list_reduce(list_transform({tokens}, lambda t_: struct_pack(i := 0, t := t_)), lambda a_, b_: case when a_.i < len({name}) and {same} "
        f"then struct_pack(i := a_.i + 1, t := a_.t) else a_ end, struct_pack(i := 0, t := ''))).i, 0) = len({name})"
    )


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def acts(token: str, action: str) -> str:
    return (
        f"({token} = {action} or ({stem(token)}) = {action} or {alike(token, action)} "
        f"or (length({action}) >= 3 and starts_with({token}, {action}) and length({token}) > length({action})))"
    )


def held(vocabulary, *texts: str) -> str:
    return number(listed(vocabulary), "v", " or ".join(f"contains({t}, v)" for t in texts))


CALLABLE = "kind in ('function', 'method')"
OWNER = "case when contains(qualified_name, '.') then regexp_replace(qualified_name, '\\.[^.]*$', '') else '' end"


def prepared(source: str) -> str:
    """Derived columns of the rows of ``source``."""
    pairs = f"flatten(list_transform({words(strict('question'), 2)}, lambda t: [t, {stem('t')}]))"
    return f"""
select *,
  kind = 'method' and starts_with(name, '__') and ends_with(name, '__') as is_dunder,
  kind = 'method' and regexp_matches(text, '(^|\\n)\\s*@property\\b') as is_property,
  contains(q_norm, s_norm) as names_symbol,
  contains(q_norm, s_norm) or contains(question, name) or (name = '__init__' and {has(ft.CONSTRUCTOR_WORDS)}) as asks_dunder,
  case when len(b_tokens) >= 3 and b_tokens[1] in ('handle', 'on') then b_tokens[2:] else b_tokens end as trimmed,
  {once("regexp_extract_all(q_norm, '\\b([a-z0-9]+)\\s+decorators?\\b', 1)")} as targets,
  {once("regexp_extract_all(question, '\\b([A-Za-z_][A-Za-z0-9_]*\\.[A-Za-z_][A-Za-z0-9_]*)\\b', 1)")} as refs
from (
  select *, list_filter({once("pairs_")}, lambda t: length(t) >= 2) as q_tokens, {words('s_norm')} as s_tokens, {words('n_norm')} as n_tokens,
    {words('f_norm')} as f_tokens
  from (
    select *, {pairs} as pairs_, {strict('question')} as q_norm, {strict('qualified_name')} as s_norm, {strict('name')} as n_norm,
      {strict('path')} as f_norm, {strict('text')} as c_norm, {words(strict("regexp_replace(name, '^_+', '')"))} as b_tokens,
      {words(strict(OWNER))} as o_tokens, {words(strict("regexp_replace(split_part(path, '/', -1), '[.]py$', '')"))} as stem_tokens
    from {source}))"""


_IN_SYMBOL = f"(contains(s_norm, t) or {among('n_tokens', 't')})"
_IN_NAME = f"(contains(n_norm, t) or {among('n_tokens', 't')})"
_PROPERTY = "(is_property and not names_symbol)"
_QUIET = "(is_dunder and not asks_dunder)"
_SINGLE = f"(len(b_tokens) = 1 and {some('targets', 't', among('b_tokens', 't'))})"
_HINT = strict("regexp_replace(h, '\\.py$', '')")
_HINT_WORDS = f"list_filter({words(_HINT, 2)}, lambda p: p <> 'py')"
_RAW = "list_filter(list_transform(regexp_split_to_array(trim(question), '\\s+'), lambda t: regexp_replace(t, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g')), lambda t: regexp_matches(t, '[._]'))"


def _sum(l: str) -> str:
    return f"coalesce(list_sum({l}), 0)"


def _first(test: str) -> str:
    return f"coalesce(list_position(list_transform(q_tokens, lambda t: {test}), true), 0)"


WORDS = f"{number('q_tokens', 't', 'contains(c_norm, t)')} + 2 * {number('q_tokens', 't', _IN_SYMBOL)} + {number('q_tokens', 't', 'contains(f_norm, t)')}"
WORD_REASONS = (
    f"list_transform(list_sort(list_filter([struct_pack(at := {_first(_IN_SYMBOL)}, slot := 0, r := 'symbol name match'), "
    f"struct_pack(at := case when kind = 'method' then {_first(_IN_NAME)} else 0 end, slot := 1, r := 'method name match'), "
    f"struct_pack(at := {_first('contains(f_norm, t)')}, slot := 2, r := 'file path match')], lambda p: p.at > 0)), lambda p: p.r)"
)
_FLOW, _DI = held(ft.FLOW_EVIDENCE, "c_norm", "s_norm"), held(ft.DI_EVIDENCE, "c_norm", "s_norm")
_CY = held(ft.CYTHON_EVIDENCE, "c_norm", "s_norm", "f_norm")
_ACTIONS = f"list_filter({listed(ft.ACTION_WORDS)}, lambda a: list_contains(q_tokens, a))"
_FILE_ACTIONS = f"list_filter({listed(ft.FILE_ACTION_WORDS)}, lambda a: list_contains(q_tokens, a))"
_COVERED = f"list_filter(b_tokens, lambda t: t not in {in_list(ft.COVERAGE_SKIPPED)})"
_STEM4 = "list_filter(stem_tokens, lambda t: length(t) >= 4)"
_PHRASES = f"list_filter(list_transform({_RAW}, lambda t: {strict('t')}), lambda p: contains(p, ' '))"

# name, score, reason, whether a negative score is named too; in the order in which reasons are listed
BEFORE = (
    ("exact_identifier", f"case when len(s_tokens) > 1 and names_symbol then case when {CALLABLE} then 6 else 3 end else 0 end", "exact identifier match", False),
    ("exact_symbol", f"case when not {CALLABLE} then 0 when is_dunder and asks_dunder then 18 when len(trimmed) < 2 then 0 "
     f"when contains(q_norm, array_to_string(trimmed, ' ')) then 10 when {in_order('trimmed')} then 8 else 0 end", "exact symbol name match", False),
    ("exact_class", "case when kind = 'class' and (contains(q_norm, n_norm || ' class') or contains(q_norm, 'class ' || n_norm)) then 6 else 0 end",
     "exact class name match", False),
)
AFTER = (
    ("core_symbol", f"case when len(stem_tokens) > 0 and kind = 'function' and len(b_tokens) = len(stem_tokens) and {every('stem_tokens', 't', among('b_tokens', 't'))} "
     f"then 6 else 0 end - 8 * len(list_intersect(b_tokens, {listed(ft.SUPPORT_WORDS)}))", "core symbol match", False),
    ("owner_name", f"case when kind = 'method' and not {_PROPERTY} and list_has_any(o_tokens, q_tokens) and list_has_any(n_tokens, q_tokens) then 3 else 0 end",
     "method owner/name match", False),
    ("owner_source", f"case when kind = 'method' and not {_PROPERTY} and not {_QUIET} and not (name in {in_list(ft.HTTP_VERBS)} and not list_has_any(n_tokens, q_tokens)) "
     f"and (len(targets) = 0 or {_SINGLE}) and {every('o_tokens', 't', 'list_contains(q_tokens, t)')} and "
     f"{number('q_tokens', 't', 'not list_contains(o_tokens, t) and length(t) >= 4 and contains(c_norm, t)')} >= 2 then 3 else 0 end", "method owner/source match", False),
    ("coverage", f"case when len({_COVERED}) >= 2 and {every(_COVERED, 't', among('q_tokens', 't'))} then 4 else 0 end", "symbol token coverage match", False),
    ("action_domain", f"case when {CALLABLE} and {some(_ACTIONS, 'a', some('b_tokens', 's', acts('s', 'a')))} and "
     f"{some('q_tokens', 't', f'not list_contains({_ACTIONS}, t) and length(t) >= 5 and ' + among('b_tokens', 't'))} then 14 else 0 end",
     "action/domain symbol match", False),
    ("file_context", f"case when kind in ('function', 'method', 'class') and len({_STEM4}) > 0 and {every(_STEM4, 't', among('q_tokens', 't'))} and "
     f"{some(_FILE_ACTIONS, 'a', some('b_tokens', 's', acts('s', 'a')))} then 16 else 0 end", "exact file context match", False),
    ("path_hint", f"least({_sum(f'''list_transform(coalesce(path_hints, []), lambda h: case when {_HINT} = '' then 0
       when regexp_matches(h, '[/\\\\]') and regexp_matches(h, '\\.[A-Za-z0-9]+$') and (f_norm = {_HINT} or ends_with(f_norm, ' ' || {_HINT})) then 28
       when contains(f_norm, {_HINT}) then case when regexp_matches(h, '[/\\\\]') then 14 else 2 end
       when len({_HINT_WORDS}) > 0 and {every(_HINT_WORDS, 't', among('f_tokens', 't'))} then 2 else 0 end)''')}, 30)", "path hint match", False),
    ("swift_body", f"case when path like '%.swift' and kind = 'method' and name = 'body' and {has(('body',))} and ({has(('swiftui',))} or "
     f"({has(('view',))} and {has(('body', 'model', 'action', 'button'))})) then 14 else 0 end", "SwiftUI view body flow match", False),
    ("kotlin", f"""case when regexp_matches(path, '\\.kts?$') then least(
       case when {has(ft.FLOW_WORDS)} and {_FLOW} > 0 and {CALLABLE} then least(10 + 3 * {_FLOW}, 24) else 0 end
       + case when {has(ft.GRADLE_WORDS)} and path like '%.gradle.kts' then 12 + case when starts_with(s_norm, 'gradle ') then 10 else 0 end
         + case when {held(ft.GRADLE_SYMBOLS, 's_norm')} > 0 then 8 else 0 end else 0 end
       + case when {has(ft.DI_WORDS)} and {_DI} > 0 then least(8 + 4 * {_DI}, 24) else 0 end
       + case when {has(('extension', 'receiver'))} and kind = 'function' and len(s_tokens) >= 2
         then 12 + case when contains(c_norm, 'fun ') and contains(qualified_name, '.') then 8 else 0 end else 0 end
       + case when {has(('viewmodel', 'ui', 'state'))} and contains(f_norm, 'viewmodel') then 8 else 0 end, 36) else 0 end""",
     "Kotlin navigation signal match", False),
    ("build_tool", f"""case when (path like '%.gradle.kts' or path like '%pom.xml' or path like '%libs.versions.toml') and {has(ft.BUILD_WORDS)} then least(
       10 + case when regexp_matches(s_norm, '^(gradle|maven) ') then 10 else 0 end + case when {held(ft.BUILD_SYMBOLS, 's_norm')} > 0 then 8 else 0 end
       + case when {held(ft.BUILD_EVIDENCE, 'c_norm')} > 0 then 6 else 0 end, 30) else 0 end""", "build tool ownership match", False),
    ("cython", f"""case when regexp_matches(path, '\\.(pyx|pxd|pxi)(\\.(tp|in))?$') and {has(ft.CYTHON_WORDS)} and {_CY} > 0
       then least(case when {CALLABLE} then 8 when kind = 'class' then 5 else 2 end + 3 * {_CY}, 28) else 0 end""", "Cython navigation signal match", False),
    ("test_api", f"""case when role = 'test' then least(
       8 * {number(once(_PHRASES), 'p', 'contains(c_norm, p)')} + 10 * {number(once(_PHRASES), 'p', 'contains(n_norm, p)')}
       + least(2 * {number('q_tokens', 't', 'length(t) >= 5 and list_contains(n_tokens, t)')}, 8)
       + {_sum(f'''list_transform({once(_RAW)}, lambda t: case
           when regexp_matches(text, '(?:\\.|\\b)\\Q' || split_part(t, '.', -1) || '\\E\\s*\\(') then 14
           when regexp_matches(text, '\\b\\Q' || split_part(t, '.', -1) || '\\E\\s*=') then 4 else 0 end)''')}, 36) else 0 end""", "test API evidence match", False),
    ("decorator", f"case when {CALLABLE} and len(targets) > 0 and {_SINGLE} then 8 else 0 end", "decorator target match", False),
    ("representation", f"case when kind = 'class' and {has(ft.REPRESENTATION_WORDS)} and len(n_tokens) > 0 and {every('n_tokens', 't', 'list_contains(q_tokens, t)')} "
     "then 8 + case when contains(f_norm, 'config') then 4 else 0 end else 0 end", "representation class match", False),
    ("container", f"case when kind = 'class' and names_symbol and not {has(('class', *ft.REPRESENTATION_WORDS))} and "
     f"{number('q_tokens', 't', 'length(t) >= 5 and not list_contains(s_tokens, t)')} >= 4 then -14 else 0 end", "named class container context", True),
    ("hook", f"case when contains(split_part(path, '/', -1), 'hookspec') and not {has(ft.HOOK_WORDS)} then -16 else 0 end", "hook specification context", True),
    ("option", f"case when regexp_matches(n_norm, 'addoption|add option|add argument') and regexp_matches(question, '--[A-Za-z0-9][A-Za-z0-9-]*') "
     f"and not {has(ft.OPTION_WORDS)} then -10 else 0 end", "option registration context", True),
    ("flag", "case when " + some("regexp_extract_all(question, '--([A-Za-z][A-Za-z0-9-]*)\\b', 1)", "g",
     "length(g) <= 3 and contains(regexp_replace(qualified_name, '[^A-Za-z0-9]', '', 'g'), upper(g))") + " then 12 else 0 end", "short flag symbol match", False),
)

_OWN = "list_filter(b_tokens, lambda t: not list_contains(o_tokens, t))"
_PHRASE = "array_to_string(o_tokens, ' ')"
_CAMEL = "regexp_matches(question, '\\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\\b')"
_DONE = "(case when b_tokens[1] = 'do' and len(b_tokens) > 1 then b_tokens[2:] else b_tokens end)"
_KNOWN = f"case when len(o_tokens) > 1 then contains(q_norm, {_PHRASE}) else list_contains(q_tokens, o_tokens[1]) end"
_REF = f"(name = split_part(r, '.', -1) and (not regexp_matches(split_part(r, '.', 1), '^[A-Z]') or {strict(OWNER)} = {strict(chr(115) + 'plit_part(r, ' + chr(39) + '.' + chr(39) + ', 1)')}))"
_DIRECT = f"list_filter(q_tokens, lambda t: t in {in_list(it.OWNER_ACTIONS)})[1]"
_OBJECTS = f"list_filter(b_tokens[2:], lambda t: t not in {in_list(ft.CONNECTORS)})"
_MADE_AT = f"coalesce(list_position(list_transform(q_tokens, lambda t: t in {in_list(it.FACTORY_QUESTION)}), true), 0)"
_MADE = f"(case when {_MADE_AT} > 0 then list_filter(q_tokens[{_MADE_AT} + 1:], lambda t: t not in {in_list(ft.CONNECTORS)})[1] end)"
_OBJECT_SCORE = (
    f"(case when coalesce({alike(f'{_OBJECTS}[1]', _MADE)}, false) then 40 "
    f"when {every(_OBJECTS, 't', f'list_contains(q_tokens, t) or list_contains(q_tokens, {stem(chr(116))})')} then 18 else 0 end)"
)
_OVERLAP = number("q_tokens", "t", (
    f"length(t) >= 3 and t not in {in_list(it.DECISION_GENERIC)} and ({stem('t')}) not in {in_list(it.DECISION_GENERIC)} and (list_contains(b_tokens, t) "
    f"or list_contains(b_tokens, {stem('t')}) or contains({strict(chr(113) + 'ualified_name || chr(32) || path || chr(32) || text')}, t))"))
_LEVEL = "contains(q_norm, 'module level')"


def _domain(domain: str, word: str) -> str:
    aliases = "".join(f" or (({stem(domain)}) = '{n}' and ({stem(word)}) in {in_list(a)})" for n, a in it.DOMAIN_ALIASES.items())
    return f"(({stem(domain)}) = ({stem(word)}){aliases})"


_WANTED = f"list_filter(q_tokens, lambda t: {some(listed(it.DOMAIN_MODULES), 'd', _domain('d', 't'))})"
_COMPATIBLE = (
    f"({has(('convert', 'conversion', 'encode', 'encoder'))} and {has(('json', 'jsonable'))} and {has(('compatible', 'data', 'value', 'values'))})"
)
_LIFE = f"list_filter({listed(it.LIFECYCLE_ACTIONS)}, lambda a: list_contains(q_tokens, a))"
_LIVED = number(_LIFE, "a", some("b_tokens", "s", acts("s", "a")))
_LIFE_DOMAIN = number("q_tokens", "t", f"length(t) >= 4 and not list_contains({_LIFE}, t) and {among('b_tokens', 't')}")
ENTRY = f"(contains(q_norm, 'entry point') or {has(('entrypoint',))} or ({has(('cli', 'console'))} and {has(('main',))}))"
_CONSOLE = f"({has(('console',))} and {has(('main',))})"


def _when(*terms: tuple[str, str]) -> str:
    return " + ".join(f"case when {test} then {points} else 0 end" for test, points in terms)


_DUMPED = f"list_contains(q_tokens, t) or (t = 'dump' and {has(it.DUMP_WORDS)})"
_CONFIGS = "t in ('config', 'configuration')"
_DOTTED = (
    f"case when (r <> lower(r) or {_LEVEL} or {has(it.API_WORDS)}) and {_REF} then case when regexp_matches(r, '^[A-Z]') then 34 else 18 end "
    f"+ case when starts_with(path, split_part(r, '.', 1) || '/') then 8 else 0 end + case when {_LEVEL} and kind = 'function' then 8 else 0 end "
    f"+ case when {has(('function',))} and kind = 'function' then 6 else 0 end + case when {has(('defined', 'definition'))} then 4 else 0 end "
    f"- case when kind = 'method' and {_LEVEL} then 10 else 0 end else 0 end"
)
GENERAL = (
    ("named owner API intent", f"""case when {_CAMEL} and kind = 'method' and not {_PROPERTY} and not {_QUIET} and len(o_tokens) > 0 and contains(q_norm, {_PHRASE})
       and len({_OWN}) > 0 and {every(_OWN, 't', _DUMPED)} and (len(b_tokens) > len({_OWN}) or {has(it.PUBLIC_API_WORDS, _OWN)})
       then 44 + 5 * least(len({_OWN}), 3) + case when len(b_tokens) > len({_OWN}) then 4 else 0 end + case when contains(f_norm, o_tokens[-1]) then 2 else 0 end else 0 end"""),
    ("owner method intent", f"""case when {_CAMEL} and kind = 'method' and not (regexp_matches(question, '__[A-Za-z0-9_]+__') and not asks_dunder) and not {_QUIET}
       and len(o_tokens) > 0 and len({_DONE}) > 0 and not ({has(('compiler', 'sqlcompiler'))} and not {has(('compiler', 'sqlcompiler'), 'o_tokens')})
       and {_KNOWN} and {in_order(_DONE)}
       then 22 + 4 * least(len({_DONE}), 3) + case when len({_DONE}) >= 2 then 4 else 0 end + case when len(o_tokens) > 1 then 18 else 0 end
       + case when b_tokens[1] = 'do' then 8 else 0 end else 0 end"""),
    ("direct owner action intent", f"""case when kind = 'method' and {_DIRECT} is not null and not ({some('refs', 'r', "regexp_matches(r, '^[A-Z]')")} and not {some('refs', 'r', _REF)})
       and len(o_tokens) > 0 and {every('o_tokens', 't', 'list_contains(q_tokens, t)')}
       and not ({_DIRECT} = 'parse' and {every('o_tokens', 't', _CONFIGS)} and {has(('console', 'command', 'session', 'main'))})
       and {some('b_tokens', 's', acts('s', _DIRECT))} then 34 + 3 * least(len(b_tokens), 3) else 0 end"""),
    ("create object factory intent", f"""case when kind = 'function' and {has(it.FACTORY_QUESTION)} and b_tokens[1] in {in_list(it.FACTORY_ACTIONS)} and len({_OBJECTS}) > 0
       and {_OBJECT_SCORE} > 0 then {_OBJECT_SCORE} + case when {in_order('b_tokens')} then 8 else 0 end else 0 end"""),
    ("default decision resolver intent", f"""case when {has(it.DEFAULT_WORDS)} and {has(it.DECISION_WORDS)} and role = 'source' and {CALLABLE} and {has(it.DEFAULT_WORDS, 'b_tokens')}
       and {some('b_tokens', 't', f'({stem(chr(116))}) in {in_list(it.RESOLVER_WORDS)}')} and {_OVERLAP} > 0
       then 42 + least(8 * {_OVERLAP}, 24) + case when kind = 'function' then 8 else 0 end else 0 end"""),
    ("dotted API reference match", f"coalesce(list_max(list_transform(refs, lambda r: {_DOTTED})), 0)"),
    ("module domain intent", f"""case when kind in ('function', 'method', 'class') and len({_WANTED}) > 0
       and {some(_STEM4, 'f', some(_WANTED, 'q', _domain('f', 'q')))} and not ({some(_STEM4, 'f', f"({stem('f')}) = 'reader'")} and not {has(it.READER_WORDS)})
       then 20 + case when {CALLABLE} then 6 else 0 end + 6 * {number('b_tokens', 't', among('q_tokens', 't'))}
       + {number('q_tokens', 't', 'length(t) >= 4 and contains(c_norm, t)')} else 0 end"""),
    ("object serialization intent", f"""case when {CALLABLE} and {has(it.SERIALIZE_ACTIONS)} and {has(it.SERIALIZE_OBJECTS)} and {has(it.SERIALIZE_OUTPUTS)} then {_when(
        (f"{has(('dict', 'dictionary', 'dictionaries'))} and n_norm in ('asdict', 'to dict')", '42'), (f"{has(('tuple', 'tuples'))} and n_norm in ('astuple', 'to tuple')", '42'),
        (f"{has(('json', 'jsonable'))} and n_norm in ('to json', 'json')", '34'), (f"{_COMPATIBLE} and regexp_matches(n_norm, 'jsonable|encode')", '48'),
        (f"{_COMPATIBLE} and contains(s_norm, 'encoder')", '10'), ("contains(s_norm, 'serializ')", '8'))} else 0 end"""),
    ("lifecycle action match", f"case when {CALLABLE} and len({_LIFE}) >= 2 and {_LIVED} > 0 and {_LIFE_DOMAIN} > 0 then 10 * {_LIVED} + 4 * least({_LIFE_DOMAIN}, 2) else 0 end"),
    ("entrypoint intent match", f"""case when {ENTRY} then {_when(
        ("path like '%\\_\\_main\\_\\_.py' escape '\\'", '20'), (f"{_CONSOLE} and n_norm = 'console main'", '48'), (f"{_CONSOLE} and n_norm = 'main'", '12'),
        ("name = 'main'", '24'), ("name = '_main'", '10'), ("name = 'main' and contains(f_norm, 'application')", '8'),
        ("name = 'main' and contains(c_norm, 'application')", '4'), ("name = 'main' and contains(c_norm, 'run')", '4'), ("contains(s_norm, ' cli ')", '6'))} else 0 end"""),
)


def gate(rule) -> str:
    tests = [has(group) for group in rule.all_of] + ([f"not {has(rule.none_of)}"] if rule.none_of else [])
    return "(" + " and ".join(tests) + ")"


def _literal(rule) -> str:
    fields = {"name": "name", "symbol": "s_norm", "text": "c_norm", "path": "path"}
    terms = []
    for field, op, literal, points, *word in rule.tests:
        test = {"is": f"{fields[field]} = '{literal}'", "has": f"contains({fields[field]}, '{literal}')", "ends": f"ends_with({fields[field]}, '{literal}')"}[op]
        terms.append((test + (f" and {has(word)}" if word else ""), str(points)))
    return f"case when {gate(rule)} then {_when(*terms)} else 0 end"


def boosted(source: str) -> str:
    """Boost and reasons of prepared rows."""
    rules = [*GENERAL, *((r.reason, _literal(r)) for r in it.LITERAL_RULES)]
    packed = ", ".join(f"struct_pack(r := '{reason}', s := ({score})::double)" for reason, score in rules)
    return f"""
select * exclude (fired_), coalesce(list_max(list_transform(fired_, lambda x: x.s)) + {it.RULE_BOOST}, 0.0) as boost,
  {once('list_transform(fired_, lambda x: x.r)')} as reasons
from (select *, list_filter([{packed}], lambda x: x.s > 0) as fired_ from {source})"""


def scored(source: str) -> str:
    """All features, score and why of prepared rows that carry boost, reasons and has_neighbours."""
    named = [*BEFORE, *AFTER]
    columns = ", ".join(f"({score})::double as f_{name}" for name, score, _, _ in named)
    total = " + ".join(f"f_{name}" for name, *_ in named)
    said = lambda part: ", ".join(f"case when f_{n} {'<>' if signed else '>'} 0 then ['{r}'] else [] end" for n, _, r, signed in part)
    return f"""
select *, round(1.0 + f_words + boost + case when has_neighbours then 0.5 else 0.0 end + {total}, 3) as score, {once('why_')} as why
from (
  select *, flatten([['matched source text'], f_word_reasons, {said(BEFORE)}, case when boost > 0 then reasons else [] end, {said(AFTER)},
    case when has_neighbours then ['nearby graph edge'] else [] end]) as why_
  from (select *, ({WORDS})::double as f_words, {WORD_REASONS} as f_word_reasons, {columns} from {source}))"""


def _filled(template: str) -> str:
    text = template.replace("'", "''")
    for field in "abcd":
        text = text.replace("{" + field + "}", f"' || {field} || '").replace("{" + field.upper() + "}", f"' || upper(left({field}, 1)) || substr({field}, 2) || '")
    text = text.replace("\n", "' || chr(10) || '")
    return f"'{text}'"


def case_rows() -> str:
    cases = []
    for i, case in enumerate(CASES):
        fields = ", ".join(f"{f} := {_filled(case[f])}" for f in FIELDS)
        hints = ", ".join(_filled(h) for h in case["hints"])
        cases.append(f"when {i} then struct_pack({fields}, path_hints := [{hints}]::varchar[])")
    found = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,9}')"
    return f"""
select doc_id, x.* from (
  select doc_id, case ((doc_id % {len(CASES)}) + {len(CASES)}) % {len(CASES)} {' '.join(cases)} end as x
  from (select doc_id, w[1] as a, w[2] as b, w[3] as c, w[4] as d from (
    select doc_id, list_concat({once('f')}, {listed(SPARE_WORDS)}) as w from (select doc_id, {found} as f from documents))))"""


def match_features() -> str:
    names = ", ".join(sorted(f"f_{n}" for n in ("words", *(x[0] for x in (*BEFORE, *AFTER)))))
    return f"""
with cases as materialized ({case_rows()}), ready as materialized ({prepared('cases')}), boosts as materialized ({boosted('ready')}),
near as (select *, doc_id % 3 = 0 as has_neighbours from boosts), done as ({scored('near')})
select doc_id, {names}, boost, score, array_to_string(why, '; ') as why from done"""
