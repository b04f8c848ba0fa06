"""DuckDB SQL fragments for the oracle queries.

They are only used to build the SQL that checks our Spark plans; nothing in the
library executes them. Word lists are shared with the library; patterns and rules
are written here a second time.
"""

from __future__ import annotations

from textindex.functions.stopwords import stopwords

TOKEN_PATTERN = "[A-Za-z]+"
WHITESPACE_CLASS = (r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_str(w) for w in words) + "]"


def sql_in_list(words) -> str:
    return "(" + ", ".join(sql_str(w) for w in words) + ")"


STOP_EN = sql_in_list(stopwords("english"))
STOP_ES = sql_in_list(stopwords("spanish"))


def tokens(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{TOKEN_PATTERN}')"


def normalized(text: str) -> str:
    return f"list_filter(list_transform({tokens(text)}, lambda t: lower(t)), lambda t: t <> '')"


def terms(text: str, language: str = "english") -> str:
    stop = STOP_ES if language == "spanish" else STOP_EN
    return f"list_filter({normalized(text)}, lambda t: t NOT IN {stop})"


def terms_by_lang(text: str, lang: str) -> str:
    return (f"CASE WHEN lower(trim({lang})) IN ('spanish', 'es') THEN {terms(text, 'spanish')} "
            f"ELSE {terms(text, 'english')} END")


def trim_go(expr: str) -> str:
    ws = WHITESPACE_CLASS
    return f"regexp_replace({expr}, '^{ws}+|{ws}+$', '', 'g')"


def collapse_ws(expr: str) -> str:
    return trim_go(f"regexp_replace({expr}, '{WHITESPACE_CLASS}+', ' ', 'g')")


def title_from_text(text: str, path: str) -> str:
    lines = f"list_transform(string_split({text}, chr(10)), lambda l: {trim_go('l')})"
    first = f"coalesce(list_filter({lines}, lambda l: l <> '')[1], '')"
    return f"coalesce(nullif({first}, ''), string_split({path}, '/')[-1])"


def idf(df: str, n: str) -> str:
    return f"(CASE WHEN {df} = 0 OR {n} = 0 THEN 0.0 ELSE ln(1 + CAST({n} AS DOUBLE) / {df}) END)"


DOC_PATH = "(source || '/' || CAST(doc_id AS VARCHAR) || '.txt')"

# The document model of ``textindex.sources.tables.corpus_documents``.
CORPUS_DOCS = (f"SELECT doc_id, 'file' AS source_type, {DOC_PATH} AS url, "
               f"{title_from_text('text', DOC_PATH)} AS title, text AS content, "
               f"{DOC_PATH} AS file_path, lang FROM documents")


# ---------------------------------------------------------------------------
# HTML and URLs, written for DuckDB from the semantics: nothing here is imported
# from the Spark expressions that it checks.
# ---------------------------------------------------------------------------

# The named references that the test pages and their variants hold, and
# those of them that may lack their semicolon.
_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
          "middot": "·", "copy": "©", "reg": "®", "eacute": "é", "hellip": "…"}
_OPEN_NAMES = "amp lt gt quot nbsp middot copy reg eacute".split()


def decode_entities(expr: str, attribute: bool = False) -> str:
    named = " ".join(f"WHEN r = {sql_str('&' + n + ';')} THEN {sql_str(t)}" for n, t in _NAMES.items())
    if attribute:       # whole names only, and none before an equals sign
        loose = " ".join(f"WHEN r = {sql_str('&' + n)} THEN {sql_str(_NAMES[n])}" for n in _OPEN_NAMES)
    else:
        loose = " ".join(f"WHEN starts_with(r, {sql_str('&' + n)}) THEN {sql_str(_NAMES[n])} || "
                         f"substring(r, {len(n) + 2})" for n in _OPEN_NAMES)
    ref = f"'&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*{'[;=]?' if attribute else ';?'})'"
    one = (f"CASE {named} "
           f"WHEN regexp_matches(r, '^&#[0-9]+;?$') THEN chr(CAST(regexp_extract(r, '[0-9]+') AS INTEGER)) "
           f"WHEN regexp_matches(r, '^&#[xX]') THEN "
           f"chr(CAST('0x' || regexp_extract(r, '^&#[xX]([0-9A-Fa-f]+)', 1) AS INTEGER)) "
           f"{loose} ELSE r END")
    return (f"list_reduce(list_transform(string_split_regex({expr}, {ref}), lambda p, i: p || coalesce("
            f"list_transform(regexp_extract_all({expr}, {ref}), lambda r: {one})[i], '')), "
            f"lambda a, b: a || b)")


# A page as a list of comments, raw elements, tags and texts; the patterns are RE2's,
# which has neither look-ahead nor back-references.
_IN_TAG = r"""(?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)|[^>])*"""
_RAW_NAMES = "script style noscript textarea title iframe xmp noembed noframes".split()
_RAW_ELEMENTS = "|".join(rf"<{n}(?:[\s/]{_IN_TAG})?>.*?(?:</{n}(?:[\s/][^>]*)?>|\z)" for n in _RAW_NAMES)
_LEXER = rf"(?is)<!--.*?(?:-->|\z)|<!{_IN_TAG}>|{_RAW_ELEMENTS}|</?[a-z]{_IN_TAG}>|[^<]+|<"


def _lexed(html: str) -> str:
    return f"regexp_extract_all({html}, {sql_str(_LEXER)})"


def _named(l: str) -> str:
    return f"lower(regexp_extract({l}, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1))"


def _content(l: str) -> str:
    """Inside of a raw element."""
    start = sql_str(rf"(?is)^<[a-z]+(?:[\s/]{_IN_TAG})?>")
    return f"regexp_replace(regexp_replace({l}, {start}, ''), '(?is)</[a-z]+[^<>]*>$', '')"


def html_title(html: str) -> str:
    first = f"list_filter(lx, lambda l: {_named('l')} = 'title')[1]"
    return (f"(SELECT coalesce({trim_go(decode_entities('t'))}, '') FROM (SELECT {_content(first)} AS t "
            f"FROM (SELECT {_lexed(html)} AS lx)))")


def visible_text(html: str) -> str:
    head = ("('', 'html', 'head', 'title', 'meta', 'link', 'base', 'basefont', 'bgsound', 'script', 'style', "
            "'noscript', 'noframes', 'template')")
    opener = (f"CASE WHEN l LIKE '<%' AND l <> '<' THEN {_named('l')} NOT IN {head} AND {_named('l')} NOT LIKE '/%' "
              f"ELSE {trim_go('l')} <> '' END")
    blocks = ("^/?(?:address|article|aside|blockquote|br|d[dlt]|div|fig(?:ure|caption)|footer|form|h[1-6]|h[er]|header"
              "|li|main|nav|[ou]l|p|pre|section|t(?:able|body|d|foot|h|head|r))$")
    piece = (f"CASE WHEN l NOT LIKE '<%' OR l = '<' THEN l WHEN l LIKE '<!%' THEN ' ' "
             f"WHEN {_named('l')} IN ('script', 'style', 'noscript') OR regexp_matches({_named('l')}, '{blocks}') THEN ' ' "
             f"WHEN {_named('l')} IN {sql_in_list(_RAW_NAMES)} THEN {_content('l')} ELSE chr(1) END")
    joined = f"replace({decode_entities('shown_text')}, chr(1), '')"
    return (f"(SELECT coalesce({collapse_ws(joined)}, '') FROM ("
            f"SELECT array_to_string(list_transform(lx[first_shown:], lambda l: {piece}), '') AS shown_text FROM ("
            f"SELECT lx, coalesce(list_position(list_transform(lx, lambda l: {opener}), true), len(lx) + 1) AS first_shown "
            f"FROM (SELECT {_lexed(html)} AS lx))))")


def hrefs(html: str) -> str:
    attribute = r"""[^\s/>=<]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?"""
    links = f"list_filter({_lexed(html)}, lambda l: {_named('l')} = 'a')"
    first = (f"list_filter(regexp_extract_all(l, {sql_str(attribute)}), "
             f"lambda x: regexp_matches(x, '(?i)^href(?:\\s*=|$)'))[1]")
    bare = f"trim(regexp_replace(h, '(?i)^href(?:\\s*=\\s*)?', ''), '\"' || chr(39))"
    return (f"list_transform(list_filter(list_transform({links}, lambda l: {first}), lambda h: h IS NOT NULL), "
            f"lambda h: {decode_entities(bare, attribute=True)})")


def scheme(u: str) -> str:
    return (f"(CASE WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') "
            f"THEN split_part({u}, ':', 1) ELSE '' END)")


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def hostname(u: str) -> str:
    return (f"regexp_replace(regexp_extract({authority(u)}, '^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)', 1), "
            f"'[\\[\\]]', '', 'g')")


def url_path(u: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({u}, '[?#].*$', '', 's'), "
            f"'^[a-zA-Z][a-zA-Z0-9+.-]*:', ''), '^//[^/]*', '')")


def raw_query(u: str) -> str:
    return (f"(CASE WHEN contains(split_part({u}, '#', 1), '?') "
            f"THEN regexp_replace(split_part({u}, '#', 1), '^[^?]*\\?', '', 's') ELSE '' END)")


def robots_path(u: str) -> str:
    path = f"url_decode(replace({url_path(u)}, '+', '%2B'))"
    return f"({path} || CASE WHEN {raw_query(u)} <> '' THEN '?' || {raw_query(u)} ELSE '' END)"


def remove_dot_segments(p: str) -> str:
    segs = f"string_split(substring({p}, 2), '/')"
    folded = (f"list_reduce({segs}, lambda acc, s: CASE s WHEN '.' THEN acc "
              f"WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END, '')")
    out = (f"(CASE WHEN list_last({segs}) IN ('.', '..') AND NOT ends_with({folded}, '/') "
           f"THEN {folded} || '/' ELSE {folded} END)")
    return f"coalesce(nullif({out}, ''), '/')"


def encoded(part: str) -> str:
    each = ("CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.~$&+,/:;=@!()*%?#''\\[\\]-]$') THEN c "
            "ELSE regexp_replace(upper(hex(encode(c))), '(..)', '%\\1', 'g') END")
    return f"array_to_string(list_transform(regexp_extract_all({part}, '(?s).'), lambda c: {each}), '')"


def _merge(base: str, ref_path: str) -> str:
    return f"(coalesce(nullif(regexp_extract({url_path(base)}, '^(.*/)', 1), ''), '/') || {ref_path})"


def is_valid(u: str) -> str:
    bare = (f"(regexp_replace(split_part({u}, '#', 1), '\\?.*$', '', 's') "
            f"|| regexp_extract({u}, '(#.*)$', 1))")
    host = f"regexp_extract({u}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
    legal = r"""^([^@]*@)?(\[[^\]]*\]|[^: "<>\\^`{|}\[\]]*)(:[0-9]*)?$"""
    return (f"(NOT regexp_matches({u}, '[\\x00-\\x1f\\x7f]') "
            f"AND NOT contains(regexp_replace({bare}, '%[0-9a-fA-F][0-9a-fA-F]', '', 'g'), '%') "
            f"AND ({scheme(u)} <> '' OR NOT contains(regexp_extract({u}, '^[^/?#]*'), ':')) "
            f"AND regexp_matches({host}, {sql_str(legal)}))")


def resolve(base: str, href: str) -> str:
    origin = f"({scheme(base)} || '://' || {authority(base)})"
    nofrag = f"split_part({base}, '#', 1)"
    ref_path = f"regexp_extract({href}, '^[^?#]*')"
    rest = f"substring({href}, length({ref_path}) + 1)"
    fragment = f"regexp_extract({rest}, '(#.*)$', 1)"
    suffix = f"(split_part({rest}, '#', 1) || {encoded(fragment)})"
    resolved = f"""(CASE
      WHEN starts_with({href}, 'http') THEN {href}
      WHEN {scheme(href)} <> '' THEN {href}
      WHEN starts_with({href}, '//') THEN {scheme(base)} || ':' || {encoded(ref_path)} || {suffix}
      WHEN {href} = '' THEN {nofrag}
      WHEN starts_with({href}, '#') THEN {nofrag} || {suffix}
      WHEN starts_with({href}, '?') THEN {origin} || {encoded(url_path(base))} || {suffix}
      WHEN starts_with({href}, '/') THEN {origin} || {encoded(remove_dot_segments(ref_path))} || {suffix}
      ELSE {origin} || {encoded(remove_dot_segments(_merge(base, ref_path)))} || {suffix} END)"""
    valid = f"({scheme(base)} <> '' AND {authority(base)} <> '' AND {is_valid(base)} AND {is_valid(href)})"
    return f"(CASE WHEN {valid} OR starts_with({href}, 'http') THEN {resolved} END)"


def word_count(expr: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array({expr}, '{WHITESPACE_CLASS}+'), "
            f"lambda x: x <> '')) AS BIGINT)")


def stem_ctes(tokens: str, prefix: str = "st") -> str:
    """CTEs that end in ``<prefix>_stems(language, term, stem)`` for the distinct terms
    of a relation ``tokens(language, term, ...)``: the published steps, one CTE each."""
    from textindex.functions.stemming import DUCKDB, english_steps, spanish_steps

    ctes, ends = [], []
    for language, steps in (("spanish", spanish_steps(DUCKDB)), ("english", english_steps(DUCKDB))):
        name, columns = f"{prefix}_{language}", ["language", "term"]
        ctes.append(f"{name}0 AS (SELECT DISTINCT language, term FROM {tokens} WHERE language = '{language}')")
        for i, step in enumerate(steps):
            kept = [c for c in columns if c not in step]
            columns = kept + list(step)
            made = kept + [f"{sql} AS {c}" for c, sql in step.items()]
            ctes.append(f"{name}{i + 1} AS MATERIALIZED (SELECT {', '.join(made)} FROM {name}{i})")
        ends.append(f"SELECT language, term, stem FROM {name}{len(steps)}")
    ctes.append(f"{prefix}_stems AS ({' UNION ALL '.join(ends)})")
    return ",\n".join(ctes)
