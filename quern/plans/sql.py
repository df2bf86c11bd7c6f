"""SQL for checks: fragments in DuckDB's dialect that say what the Column builders say."""

from __future__ import annotations

from quern.functions import text as t
from quern.operators import planner


def q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(x: str, patterns) -> str:
    own = [patterns] if isinstance(patterns, str) else patterns
    return f"regexp_matches({x}, {lit('(?i)(?:' + '|'.join(f'(?:{p})' for p in own) + ')')})"


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({x}), 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def plain_tokens(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda w: length(w) >= 3 AND NOT list_contains({q(t.PLAIN_STOP)}, w))"


def fold(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ı', 'i'))"


def stem(w: str) -> str:
    """w: an expression of a folded word."""
    tr = f"regexp_replace({w}, '(?:{'|'.join(t.TR_SUFFIXES)})$', '')"
    en = f"regexp_replace({w}, '(?:{'|'.join(t.EN_SUFFIXES)})$', '')"
    double = f"(length({en}) >= 2 AND right({en}, 1) = substr({en}, length({en}) - 1, 1) AND NOT contains('aeiouls z', right({en}, 1)))"
    return f"""CASE WHEN length({w}) <= 4 THEN {w} WHEN length({tr}) >= 3 AND {tr} <> {w} THEN {tr}
        WHEN regexp_matches({w}, '(?:ss|us|is)$') AND NOT regexp_matches({w}, '(?:ies|ses|xes|zes|ches|shes)$') THEN {w}
        WHEN regexp_matches({w}, '[^aeiou]ie[sd]$') THEN regexp_replace({w}, 'ie[sd]$', 'y')
        WHEN length({en}) < 3 THEN {w} WHEN {double} THEN left({en}, length({en}) - 1) ELSE {en} END"""


def rank_tokens(x: str) -> str:
    raw = rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.-]*')"
    cut = rf"list_filter(list_transform({raw}, lambda w: regexp_replace(w, '^[.\-_]+|[.\-_]+$', '', 'g')), lambda w: length(w) >= 2)"
    folded = f"list_transform({cut}, lambda w: {fold('w')})"
    return f"list_filter(list_transform({folded}, lambda w: {stem('w')}), lambda w: length(w) >= 2 AND NOT list_contains({q(t.RANK_STOP)}, w))"


def sentences(x: str) -> str:
    split = rf"""string_split(regexp_replace(x, '([.!?…])\s+([A-ZÇĞİÖŞÜ0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
    parts = rf"flatten(list_transform(regexp_split_to_array({x}, '\n+'), lambda x: {split}))"
    clean = rf"list_transform({parts}, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')))"
    return f"list_filter({clean}, lambda s: length(s) BETWEEN 45 AND 400 AND NOT {any_of('s', t.NOISE)} AND NOT {any_of('s', t.QUESTION)})"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a})) = 0 OR len(list_distinct({b})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / least(len(list_distinct({a})), len(list_distinct({b})))::DOUBLE END"


def host(url: str) -> str:
    return rf"nullif(regexp_replace(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '')"


def url_key(url: str) -> str:
    bare = f"regexp_replace({url}, '#.*$', '')"
    query = rf"nullif(regexp_extract({bare}, '\?(.*)$', 1), '')"
    kept = f"list_filter(string_split({query}, '&'), lambda p: NOT regexp_matches(lower(string_split(p, '=')[1]), '^(?:utm_.*|fbclid|gclid)$'))"
    port = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*(:[0-9]+)', 1)".format(bare)
    path = "regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')".format(bare)
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {host(url)} || {port} || {path} || CASE WHEN {query} IS NOT NULL AND len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def intent(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, [p.replace(chr(92) + 'w', '[A-Za-z0-9_]') for p in ps])} THEN '{name}'" for name, ps in planner.INTENTS) + " ELSE 'general' END"


def freshness(x: str, kind: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, p)} THEN {h}" for p, h in planner.FRESHNESS) + f" WHEN {kind} = 'news' THEN 24 WHEN {kind} = 'finance' THEN 6 END"
