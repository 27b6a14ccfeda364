"""Pieces of DuckDB SQL that say again what the column functions compute, for the oracle."""

from __future__ import annotations

from larkspur.functions.hashing import FNV_OFFSET, FNV_PRIME, MIX_A, MIX_ADD, MIX_B
from larkspur.functions.text import CJK, FROM, STOP_WORDS, TO
from larkspur.functions.urls import NON_HTML, TRACKING

SPACES = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    return f"replace(translate({x}, {text(FROM)}, {text(TO)}), '…', '...')"


def tokens(x: str) -> str:
    """Token list of an expression (scripts: Latin, Greek, Cyrillic, digits, CJK)."""
    stop = ", ".join(text(w) for w in STOP_WORDS)
    split = "w.r"
    for rule in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        split = f"regexp_replace({split}, '{rule}', '\\1 \\2', 'g')"
    split = split.replace("w.r", "r")
    parts = f"string_split({split}, ' ')"
    word = f"list_filter(list_concat([lower(r)], CASE WHEN len({parts}) > 1 THEN list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: length(p) > 1) ELSE CAST([] AS VARCHAR[]) END), lambda p: p NOT IN ({stop}))"
    pairs = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END"
    runs = rf"regexp_extract_all({nfkc(x)}, '[{CJK}]+|[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{N}}]+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[{CJK}]') THEN {pairs} ELSE {word} END))"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def normalize_url(x: str) -> str:
    t = trim(x)
    part = lambda i: rf"regexp_extract({t}, '(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', {i})"
    authority = f"regexp_replace({part(2)}, '^.*@', '')"
    host = rf"lower(regexp_extract({authority}, '^(\[[^\]]*\]|[^:]*)', 1))"
    port = rf"regexp_extract({authority}, ':(\d+)$', 1)"
    scheme = f"lower({part(1)})"
    keep = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
    walked = rf"list_reduce(string_split({part(3)}, '/'), lambda acc, s: CASE WHEN s = '.' THEN acc WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END)"
    last = rf"CASE WHEN regexp_matches({part(3)}, '(^|/)\.\.?$') THEN '/' ELSE '' END"
    path = rf"CASE WHEN {part(3)} = '' THEN '/' WHEN regexp_matches({part(3)}, '(^|/)\.\.?(/|$)') THEN coalesce(nullif({walked} || {last}, ''), '/') ELSE {part(3)} END"
    bad = ", ".join(text(w) for w in TRACKING)
    items = f"list_filter(string_split({part(4)}, '&'), lambda q: NOT starts_with(lower(string_split(q, '=')[1]), 'utm_') AND lower(string_split(q, '=')[1]) NOT IN ({bad}))"
    sorted_ = f"list_transform(list_sort(list_transform({items}, lambda q: {{'n': string_split(q, '=')[1], 'v': regexp_extract(q, '(?s)=(.*)$', 1), 'q': q}})), lambda s: s.q)"
    query = f"CASE WHEN {part(4)} = '' OR len({items}) = 0 THEN '' ELSE '?' || array_to_string({sorted_}, '&') END"
    return f"CASE WHEN regexp_matches({t}, '(?is)^https?://[^/?#]') AND {host} <> '' THEN {scheme} || '://' || {host} || {keep} || {path} || {query} END"


def host_key(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({trim(x)}), ':(80|443)$', ''), '\.$', '')"


def url_host(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '^https?://(\[[^\]]*\]|[^/?#:]+)', 1), '')"


def url_path(x: str) -> str:
    return f"regexp_extract({x}, '^https?://[^/?#]+([^?#]*)', 1)"


def url_text(x: str) -> str:
    return f"translate(coalesce({url_host(x)}, '') || {url_path(x)}, '/-_.', '    ')"


def in_scope(url: str, depth: str) -> str:
    """Whether a normalised URL may be crawled, without lists of hosts."""
    parts = f"list_filter(string_split({url_path(url)}, '/'), lambda s: s <> '')"
    query = rf"regexp_extract({url}, '\?([^#]*)', 1)"
    ext = rf"lower(regexp_extract({url_path(url)}, '[^/]\.([^./]+)/?$', 1))"
    most = f"coalesce(list_max(list_transform({parts}, lambda a: len(list_filter({parts}, lambda b: b = a)))), 0)"
    trap = f"(len({parts}) > 20 OR {most} > 3 OR ({query} <> '' AND len(string_split({query}, '&')) > 10))"
    files = "', '".join(NON_HTML)
    return f"coalesce({url} IS NOT NULL AND {depth} <= 10 AND octet_length(encode({url})) <= 2048 AND NOT {trap} AND {ext} NOT IN ('{files}'), false)"


U64 = "18446744073709551616::UHUGEINT"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def fnv(x: str, seed: int = FNV_OFFSET) -> str:
    """FNV-1a 64 of a text as UHUGEINT."""
    byte = f"('0x' || substring(hex(encode({x})), CAST(2 * i - 1 AS BIGINT), 2))::INTEGER::UHUGEINT"
    return f"list_reduce(list_prepend({seed}::UHUGEINT, list_transform(range(1, octet_length(encode({x})) + 1), lambda i: {byte})), lambda h, b: (xor(h, b) * {FNV_PRIME}::UHUGEINT) % {U64})"


def mix(x: str) -> str:
    """SplitMix64 finaliser of an UHUGEINT; products of two 64-bit numbers in halves, so that 128 bits suffice."""
    half = "4294967296::UHUGEINT"
    times = lambda z, c: f"((({z} // {half}) * {c}::UHUGEINT % {half}) * {half} + ({z} % {half}) * {c}::UHUGEINT) % {U64}"
    last = let(times("e", MIX_B), "g", f"xor(g, g // {1 << 31}::UHUGEINT)")
    third = let(times("c", MIX_A), "d", let(f"xor(d, d // {1 << 27}::UHUGEINT)", "e", last))
    return let(f"({x} + {MIX_ADD}::UHUGEINT) % {U64}", "z", let(f"xor(z, z // {1 << 30}::UHUGEINT)", "c", third))


def signed(z: str) -> str:
    """An unsigned 64-bit number as the signed one of the same bits."""
    return f"CAST(CASE WHEN {z} >= 9223372036854775808 THEN CAST({z} AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST({z} AS HUGEINT) END AS BIGINT)"


def shard(url: str, shards: int) -> str:
    """Shard of an URL."""
    return f"CAST({mix(fnv(url))} % 1024::UHUGEINT % {shards}::UHUGEINT AS INTEGER)"


def simhashes(texts: str, ident: str) -> str:
    """CTEs after which ``sim`` has ``ident`` and ``h`` (UBIGINT, 0 without tokens); ``texts`` selects ``ident`` and ``t``, a list of tokens."""
    return f"""
tk AS MATERIALIZED ({texts}),
sh AS MATERIALIZED (SELECT {ident}, unnest(list_transform(range(1, greatest(len(t) - 2, 1) + 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS s FROM tk WHERE len(t) > 0),
hs AS MATERIALIZED (SELECT s, CAST({mix(fnv('s'))} AS UBIGINT) AS h FROM (SELECT DISTINCT s FROM sh)),
votes AS (SELECT {ident}, b, count(*) AS n, sum(CAST((h >> b::UBIGINT) & 1::UBIGINT AS INTEGER)) AS ones FROM sh JOIN hs USING (s), (SELECT unnest(range(0, 64)) AS b) GROUP BY {ident}, b),
sim AS MATERIALIZED (SELECT {ident}, CAST(coalesce(v, 0) AS UBIGINT) AS h FROM tk LEFT JOIN (SELECT {ident}, sum(CASE WHEN 2 * ones > n THEN CAST(1::UBIGINT << b::UBIGINT AS HUGEINT) ELSE 0 END) AS v FROM votes GROUP BY {ident}) USING ({ident}))"""
