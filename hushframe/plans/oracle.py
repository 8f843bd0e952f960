"""The same queries as SQL for DuckDB, for checking results.

RE2 has no lookaround, so phone numbers are searched in a marked copy of the
text: every run of digits is put between two control characters, which then say
where a digit may not precede or follow.  All other patterns are the detectors'
own, in RE2 spelling.
"""

from __future__ import annotations

import re

from hushframe.functions import patterns as P
from hushframe.operators import policy, routing
from hushframe.operators.detectors import DETECTORS
from hushframe.operators.language import ISO3, PROFILE_SIZE, SUPPORTED
from hushframe.plans import corpus as C
from hushframe.plans.queries import OVERRIDES
from hushframe.sources import pages


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- messages ---------------------------------------------------------------
DOCUMENTS = "SELECT source AS scope_id, doc_id AS seq, text, lang FROM documents"
CUSTOMERS = """
SELECT 'seg-' || c_mktsegment AS scope_id, c_custkey AS seq,
  'SSN ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-'
  || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-'
  || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' on host 2001:db8:'
  || substr(sha256(c_custkey::VARCHAR), 1, 4) || ':1 up, to 0x'
  || substr(sha256(c_custkey::VARCHAR), 1, 40) || ' or pay 1'
  || translate(substr(sha256(c_custkey::VARCHAR), 1, 30), '0', 'z')
  || ' now, password: user' || (c_custkey % 50)::VARCHAR || '@corp'
  || (c_custkey % 7)::VARCHAR || '.example.com#' || c_custkey::VARCHAR || ' end' AS text,
  'en' AS lang
FROM customer"""
ORDERS = """
SELECT 'prio-' || substr(o_orderpriority, 1, 1) AS scope_id, o_orderkey AS seq,
  'acct DE' || lpad((o_orderkey % 100)::VARCHAR, 2, '0')
  || lpad(o_orderkey::VARCHAR, 18, '0') || ' paid. DOB: '
  || strftime(o_orderdate, '%Y-%m-%d') || ', tel (555) '
  || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-'
  || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || '.' AS text,
  'en' AS lang
FROM orders"""
CORPUS = f"{DOCUMENTS} UNION ALL {CUSTOMERS} UNION ALL {ORDERS}"
ONE_SCOPE = " UNION ALL ".join(
    f"SELECT 'corpus' AS scope_id, seq * 3 + {i} AS seq, text, lang FROM ({part})"
    for i, part in enumerate((DOCUMENTS, CUSTOMERS, ORDERS))
)
NATIONAL = """
SELECT 'orders' AS scope_id, o_orderkey AS seq,
  'tel ' || n || ' fin ' || e || '; ' || n AS text, lang
FROM (SELECT *, CASE lang
    WHEN 'fr' THEN '06 ' || e[1:2] || ' ' || e[3:4] || '.' || e[5:6] || '-' || e[7:8]
    WHEN 'de' THEN '0176 ' || e
    WHEN 'gb' THEN '07' || e[1:3] || ' ' || e[3:8]
    WHEN 'es' THEN '6' || e[1:2] || ' ' || e[1:3] || '-' || e[4:6]
    WHEN 'it' THEN '3' || e[1:2] || ' ' || e[1:3] || ' ' || e[5:8]
    WHEN 'pt' THEN '9' || e[1:2] || '.' || e[1:3] || '.' || e[4:6]
    WHEN 'nl' THEN '06 ' || e
    ELSE '5' || e[1:2] || ' ' || e[1:3] || ' ' || e[4:6] END AS n
  FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '0') AS e,
      ['fr', 'de', 'gb', 'es', 'it', 'pt', 'nl', 'pl'][o_orderkey % 8 + 1] AS lang
    FROM orders))"""
DICTIONARY = """
SELECT phrase, CASE length(phrase) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' ELSE 'ORG' END AS entity_type
FROM (SELECT DISTINCT unnest(list_concat(regexp_extract_all(text, '[A-Z][a-z]+'),
    regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) AS phrase
  FROM documents WHERE lang = 'en')
WHERE NOT (contains(phrase, ' ') AND starts_with(split_part(phrase, ' ', 1), split_part(phrase, ' ', 2)))"""
CLEARS = """
SELECT 'src' || (user_id % 20)::VARCHAR AS scope_id, event_id // 10 AS seq
FROM events WHERE event_type = 'error'"""

# -- spans ------------------------------------------------------------------
_COLUMNS = (
    'scope_id, seq, entity_type, "start", "end", score, value, source, det_ord'
)
_LENGTHS = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
_UNMARK = "replace(replace(replace(replace(x, chr(1), ''), chr(2), ''), chr(3), '+'), chr(4), '(')"
_MARKED = (
    "replace(replace(regexp_replace(text, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g'), "
    "chr(2) || '+', chr(2) || chr(3)), chr(2) || '(', chr(2) || chr(4))"
)


def _located(messages: str, pattern: str, marked: bool = False, keep: str = "") -> str:
    """Matches with 0-based offsets: (keys, value, start, end)."""
    text = _MARKED if marked else "text"
    clean = f"list_transform({{0}}, lambda x: {_UNMARK})" if marked else "{0}"
    found = clean.format(f"regexp_extract_all(t, {_s(pattern)})")
    gaps = clean.format(f"string_split_regex(t, {_s(pattern)})")
    start = _LENGTHS.format("g[1:k]") + " + " + _LENGTHS.format("v[1:k - 1]")
    return f"""
SELECT scope_id, seq{keep}, v[k] AS value, ({start})::INTEGER AS "start",
  ({start} + length(v[k]))::INTEGER AS "end"
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k
  FROM (SELECT scope_id, seq{keep}, {found} AS v, {gaps} AS g
    FROM (SELECT scope_id, seq{keep}, {text} AS t FROM ({messages}))
    WHERE regexp_matches(t, {_s(pattern)})))"""


def _tagged(rows: str, entity: str, score: float, order: int, keep: str = "") -> str:
    return (
        f"SELECT scope_id, seq{keep}, '{entity}' AS entity_type, \"start\", \"end\", "
        f"{score}::DOUBLE AS score, value, 'regex' AS source, {order}::INTEGER AS det_ord "
        f"FROM ({rows})"
    )


def _separators(pattern: str) -> str:
    """``[sep]?`` between digits, in marked text."""
    return re.sub(r"(\[[^\]]*\\s[^\]]*\])\?", r"(?:\\x{0002}\1\\x{0001})?", pattern)


_SEP = r"[\s.\-]"
_PHONE_MARKED = P.re2_pattern(
    # ten digits, with or without a leading 1
    rf"(?:\+?\x{{0001}}1(?:\x{{0002}}{_SEP}?[(\x{{0004}}]?\x{{0001}})?|\(?\x{{0001}})\d{{3}}"
    rf"(?:\x{{0002}}\)?{_SEP}?\x{{0001}})?\d{{3}}(?:\x{{0002}}{_SEP}\x{{0001}})?\d{{4}}\x{{0002}}"
    # with a country code
    rf"|[+\x{{0003}}]\x{{0001}}\d{{1,3}}(?:\x{{0002}}{_SEP}?[(\x{{0004}}]?\x{{0001}})?\d+"
    rf"(?:\x{{0002}}\)?{_SEP}?\x{{0001}})?\d{{2,}}(?:(?:\x{{0002}}{_SEP}\x{{0001}})?\d{{2,}})+\x{{0002}}"
)


def _detector(name: str, messages: str) -> str:
    d = DETECTORS[name]
    if name == "phone":
        return _tagged(_located(messages, _PHONE_MARKED, marked=True), d.entity_type, d.score, d.det_ord)
    pattern = d.pattern
    if name == "secret":
        pattern = pattern.replace("(?:^|", r"(?:\A|", 1)
    pattern = P.re2_pattern(pattern, d.ignore_case)
    rows = _located(messages, pattern)
    if name == "card":
        weighted = (
            "list_sum(list_transform(string_split(reverse(regexp_replace(value, '[^0-9]', '', 'g')), ''),"
            " lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4"
            " THEN c::INTEGER * 2 - 9 ELSE c::INTEGER * 2 END))"
        )
        rows = f"SELECT * FROM ({rows}) WHERE {weighted} % 10 = 0"
    elif name in ("secret", "dob"):
        cut = (
            f"regexp_replace(value, {_s(P.re2_pattern(P.SECRET_LEAD))}, '')"
            if name == "secret"
            else f"regexp_extract(value, {_s(pattern)}, 1)"
        )
        rows = (
            f'SELECT scope_id, seq, ("end" - length({cut}))::INTEGER AS "start", "end", '
            f"{cut} AS value FROM ({rows})"
        )
    return _tagged(rows, d.entity_type, d.score, d.det_ord)


def _locale(messages: str, keep: str = "") -> str:
    branches = []
    for lang, pattern in P.PHONE_BY_LANG.items():
        body = pattern.replace(r"(?<!\d)", "", 1).removesuffix(r"(?!\d)")
        marked = P.re2_pattern(rf"\x{{0001}}(?:{_separators(body)})\x{{0002}}")
        rows = f"SELECT * FROM ({messages}) WHERE lang = '{lang}'"
        branches.append(
            _tagged(_located(rows, marked, True, keep), "PHONE_NUMBER", 0.95, 2, keep)
        )
    return " UNION ALL ".join(branches)


def _with(messages: str, **ctes: str) -> str:
    """``m``: messages, ``raw``: all spans, ``kept``: resolved spans."""
    parts = [f"m AS MATERIALIZED ({messages})"]
    raw = " UNION ALL ".join(
        f"SELECT {_COLUMNS} FROM ({branch})"
        for branch in [_detector(name, "FROM m") for name in DETECTORS] + [_locale("FROM m")]
    )
    parts.append(f"raw AS MATERIALIZED ({raw})")
    parts.append(f"kept AS MATERIALIZED ({_resolved('raw')})")
    parts += [f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def _resolved(raw: str, keys: str = "scope_id, seq") -> str:
    fields = ", ".join(f"d['{c}'] AS \"{c}\"" for c in _span_names())
    packed = ", ".join(f"'{c}': \"{c}\"" for c in _span_names())
    return f"""
SELECT {keys}, {fields} FROM (SELECT {keys}, unnest(list_reduce(
    list_transform(l, lambda x: [x]),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
        k['start'] < x[1]['end'] AND x[1]['start'] < k['end'])) = 0
      THEN list_concat(acc, x) ELSE acc END)) AS d
  FROM (SELECT {keys}, list({{{packed}}} ORDER BY score DESC, length(value) DESC, det_ord, "start") AS l
    FROM {raw} GROUP BY {keys}))"""


def _span_names() -> list[str]:
    return ["entity_type", "start", "end", "score", "value", "source", "det_ord"]


# -- policy -----------------------------------------------------------------
def _cases(expr: str, values: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in values.items())
    return f"CASE {expr} {whens} ELSE {_s(default)} END"


_TIER = _cases("entity_type", {e: t for e, _, t, _ in policy.CATALOGUE}, "medium")


def _decision(settings: policy.Settings) -> str:
    tiers = {t: policy.MATRIX[t, settings.mode] for t in policy.TIERS}
    matrix = _cases(f"({_TIER})", tiers, "block")
    whens = " ".join(f"WHEN {_s(e)} THEN {_s(d)}" for e, d in settings.overrides.items())
    return f"CASE entity_type {whens} ELSE {matrix} END" if whens else matrix


_RANKS = "['block', 'auto_scrub', 'warn', 'notify', 'allow']"
_TIERS = "['high', 'medium', 'low']"


def _message_decision(settings: policy.Settings) -> str:
    return (
        f"{_RANKS}[coalesce(min(list_position({_RANKS}, {_decision(settings)}))"
        " FILTER (entity_type IS NOT NULL), 5)]"
    )


_TOP = f"{_TIERS}[min(list_position({_TIERS}, {_TIER})) FILTER (entity_type IS NOT NULL)]"


def _per_message(columns: str, messages: str = CORPUS) -> str:
    return (
        _with(messages)
        + f"SELECT scope_id, seq, {columns} FROM m LEFT JOIN kept USING (scope_id, seq)"
        " GROUP BY scope_id, seq"
    )


_ANALYSED = (
    "FALSE AS failed, count(entity_type)::INTEGER AS n_detections, "
    f"{_TOP} AS top_tier, {_message_decision(policy.DEFAULT_SETTINGS)} AS decision"
)

# -- tokens -----------------------------------------------------------------
_VAULT = """
SELECT *, '<' || entity_type || '_' || idx::VARCHAR || '>' AS token FROM (
  SELECT *, row_number() OVER (PARTITION BY scope_id, entity_type
      ORDER BY first_seq, first_start, value) AS idx
  FROM (SELECT scope_id, entity_type, value,
      min(seq) AS first_seq, arg_min("start", seq * 10000000 + "start") AS first_start
    FROM {0} GROUP BY 1, 2, 3))"""


def _vault(spans: str = "kept") -> str:
    return _VAULT.format(spans)


_SCRUBBED = """
SELECT scope_id, seq, string_agg(substr(text, prev + 1, "start" - prev) || token, '' ORDER BY "start")
  || substr(any_value(text), max("end") + 1) AS scrubbed
FROM (SELECT s.*, m.text, coalesce(lag("end") OVER (PARTITION BY scope_id, seq ORDER BY "start"), 0) AS prev
  FROM spliced s JOIN m USING (scope_id, seq)) GROUP BY scope_id, seq"""
_DOC_VAULT = """
SELECT *, '<' || entity_type || '_' || (dense_rank() OVER (
    PARTITION BY scope_id, seq, entity_type ORDER BY first_start))::VARCHAR || '>' AS token
FROM (SELECT *, min("start") OVER (PARTITION BY scope_id, seq, entity_type, value) AS first_start
  FROM kept)"""
_SCRUB_DOCUMENT = (
    _with(CORPUS, spliced=_DOC_VAULT, done=_SCRUBBED)
    + "SELECT m.scope_id, m.seq, coalesce(done.scrubbed, m.text) AS scrubbed "
    "FROM m LEFT JOIN done USING (scope_id, seq)"
)
_EPOCHS = f"""
SELECT m.scope_id, m.seq, count(c.seq) AS epoch
FROM m LEFT JOIN ({CLEARS}) c ON c.scope_id = m.scope_id AND c.seq < m.seq
GROUP BY 1, 2"""
_ACTION = "CASE seq % 4 WHEN 0 THEN 'scrub' WHEN 1 THEN 'edit' WHEN 2 THEN 'send' END"
_DISPOSED = f"""
SELECT *, CASE
    WHEN NOT regexp_matches(text, {_s('[^' + P.SPACE + ']')}) THEN 'sent_raw'
    WHEN decision = 'auto_scrub' OR (decision IN ('warn', 'block') AND action IS NOT DISTINCT FROM 'scrub') THEN 'sent_scrubbed'
    WHEN decision IN ('allow', 'notify') OR (decision = 'warn' AND action IS NOT DISTINCT FROM 'send') THEN 'sent_raw'
    ELSE 'held' END AS outcome
FROM (SELECT scope_id, seq, any_value(text) AS text, count(entity_type) AS n,
    {_message_decision(OVERRIDES)} AS decision, {_ACTION} AS action
  FROM m LEFT JOIN kept USING (scope_id, seq) GROUP BY scope_id, seq)"""

# -- dictionary -------------------------------------------------------------
_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def _named(messages: str, keys: str = "scope_id, seq") -> str:
    """Phrases are one or two capitalised words whose occurrences cannot overlap."""
    start = _LENGTHS.format("g[1:k]") + " + (k - 1) * length(phrase)"
    return f"""
SELECT {keys}, entity_type, ({start})::INTEGER AS "start",
  ({start} + length(phrase))::INTEGER AS "end",
  (CASE entity_type WHEN 'PERSON' THEN 0.75 ELSE 0.65 END)::DOUBLE AS score,
  phrase AS value, 'nlp' AS source,
  (11 + list_position(['PERSON', 'LOCATION', 'ORG'], entity_type))::INTEGER AS det_ord
FROM (SELECT *, unnest(range(1, len(g))) AS k
  FROM (SELECT {keys}, phrase, entity_type, string_split(text, phrase) AS g
    FROM (SELECT {keys}, text, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)),
        lambda i: w[i] || ' ' || w[i + 1])))) AS phrase
      FROM (SELECT *, regexp_extract_all(text, {_s(_WORD)}) AS w FROM ({messages}) WHERE lang = 'en'))
      JOIN ({DICTIONARY}) USING (phrase)))"""


# -- language ---------------------------------------------------------------
def _trigrams(messages: str, keys: str) -> str:
    padded = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' '"
    return (
        f"SELECT {keys}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS trigram"
        f" FROM (SELECT {keys}, string_split({padded}, '') AS c FROM ({messages}))"
    )


_PROFILES = f"""
SELECT lang, trigram, n, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, trigram) AS rank
  FROM (SELECT lang, trigram, count(*) AS n FROM ({_trigrams(DOCUMENTS, "lang")}) GROUP BY 1, 2))
WHERE rank <= {PROFILE_SIZE}"""
def _identified(messages: str, long: str) -> str:
    """The nearest profile of each of ``messages``; ``long`` are those that are long enough."""
    return f"""
WITH profiles AS MATERIALIZED ({_PROFILES}),
ranked AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY scope_id, seq ORDER BY n DESC, trigram) AS r
  FROM (SELECT scope_id, seq, trigram, count(*) AS n
    FROM ({_trigrams(long, "scope_id, seq")}) GROUP BY 1, 2, 3))
  WHERE r <= {PROFILE_SIZE}),
distance AS (SELECT d.scope_id, d.seq, l.lang,
    sum(coalesce(abs(p.rank - d.r), {PROFILE_SIZE})) AS far
  FROM ranked d CROSS JOIN (SELECT DISTINCT lang FROM profiles) l
  LEFT JOIN profiles p ON p.lang = l.lang AND p.trigram = d.trigram GROUP BY 1, 2, 3)
SELECT m.scope_id, m.seq, coalesce(arg_min(lang, [far::VARCHAR.lpad(12, '0'), lang]), 'en') AS detected_lang
FROM (SELECT scope_id, seq FROM ({messages})) m
LEFT JOIN distance USING (scope_id, seq) GROUP BY 1, 2"""


_IDENTIFIED = _identified(DOCUMENTS, DOCUMENTS + " WHERE length(text) >= 10")
_TEXTS = (
    "SELECT source AS scope_id, doc_id AS seq, text FROM documents UNION ALL "
    "SELECT 'conv-' || conv_id::VARCHAR, turn, text FROM conversations"
)
_LONG_TEXTS = f"SELECT * FROM ({_TEXTS}) WHERE length(trim(text)) >= 10"
_TEXTS_WITH_LANG = (
    f"SELECT scope_id, seq, text, detected_lang AS lang FROM ({_TEXTS}) t "
    f"JOIN ({_identified(_TEXTS, _LONG_TEXTS)}) d USING (scope_id, seq)"
)
_NORMALISED = (
    "CASE WHEN s IN (" + ", ".join(map(_s, SUPPORTED)) + ") THEN s ELSE 'en' END"
)
_SHORT = "CASE code " + " ".join(
    f"WHEN {_s(k)} THEN {_s(v)}" for k, v in ISO3.items()
) + " ELSE substr(code, 1, 2) END"

# -- sites ------------------------------------------------------------------
_HOSTS = (
    "chatgpt.com", "www.chatgpt.com", "chat.openai.com", "claude.ai", "notclaude.ai",
    "gemini.google.com", "copilot.microsoft.com", "labs.perplexity.ai", "poe.com",
    "POE.com", "beta.character.ai", "chat.mistral.ai", "huggingface.co", "you.com",
    "thankyou.com", "poe.com.example.org",
)
_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"
_SITE = "CASE " + " ".join(
    f"WHEN host = {_s(h)} OR ends_with(host, {_s('.' + h)}) THEN {_s(n)}"
    for h, n in routing.SITES
) + " ELSE 'generic' END"
_POPUP = "CASE " + " ".join(
    f"WHEN contains(host, {_s(h)}) THEN {_s(h)}" for h in routing.POPUP_HOSTS
) + " END"
_VISITED = f"""
SELECT visit_id, {_HOST} AS host FROM (
  SELECT 'p' || page_id::VARCHAR AS visit_id, url FROM pages
  UNION ALL SELECT 'c' || c_custkey::VARCHAR, 'https://'
    || [{", ".join(map(_s, _HOSTS))}][c_custkey % {len(_HOSTS)} + 1]
    || '/c/' || c_custkey::VARCHAR || '?q=1' FROM customer)"""


def _visible(html: str) -> str:
    text = f"regexp_replace({html}, {_s(pages.HIDDEN)}, '', 'g')"
    text = f"regexp_replace({text}, {_s(pages.BLOCK)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {_s(pages.TAG)}, '', 'g')"
    for entity, char in pages.ENTITIES:
        text = f"replace({text}, {_s(entity)}, {_s(char)})"
    return text


_PAGES = (
    f"SELECT coalesce({_HOST}, '') AS scope_id, page_id AS seq, {_visible('html')} AS text,"
    " 'en' AS lang FROM pages"
)
_LABELS = ", ".join(f"({_s(e)}, {_s(l)}, {_s(t)})" for e, l, t, _ in policy.CATALOGUE)
_OVERRIDE = "CASE entity_type " + " ".join(
    f"WHEN {_s(e)} THEN {_s(d)}" for e, d in OVERRIDES.overrides.items()
) + " END"


def _summary(rows: str, violation: str) -> str:
    return (
        f"SELECT count(*) AS checked, coalesce(sum(CASE WHEN {violation} THEN 1 ELSE 0 END), 0)::BIGINT"
        f" AS violations FROM ({rows})"
    )


_KEPT_SCRUBBED = _with(CORPUS, spliced=_DOC_VAULT, done=_SCRUBBED)
_FRAGMENTS = (
    "SELECT scope_id, seq, (part - 1)::INTEGER AS part, lines[part] AS text, lang FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS part"
    f" FROM (SELECT scope_id, seq, lang, string_split(text, chr(10)) AS lines FROM ({DOCUMENTS})))"
)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["messages"] = (
        f"SELECT scope_id, seq, lang, text FROM ({DOCUMENTS}) UNION ALL "
        "SELECT 'conv-' || conv_id::VARCHAR, turn, NULL, text FROM conversations"
    )
    sql["page_exposure"] = (
        _with(_PAGES)
        + "SELECT scope_id AS host, entity_type, count(*) AS n_spans, count(DISTINCT seq) AS n_pages"
        " FROM kept GROUP BY 1, 2"
    )
    for name in DETECTORS:
        sql[f"detect_{name}"] = _detector(name, CORPUS)
    both = f"SELECT * FROM ({DOCUMENTS}) UNION ALL SELECT * FROM ({NATIONAL})"
    sql["detect_phone_locale"] = _locale(both, ", lang")
    sql["detect_all"] = _with(CORPUS) + f"SELECT {_COLUMNS} FROM raw"
    sql["luhn_valid"] = """
SELECT o_orderkey, number, list_sum(list_transform(string_split(reverse(number), ''),
    lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4
      THEN c::INTEGER * 2 - 9 ELSE c::INTEGER * 2 END)) % 10 = 0 AS valid
FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 16, '4') AS number FROM orders)"""
    sql["dictionary_occurrences"] = f"SELECT {_COLUMNS} FROM ({_named(DOCUMENTS)})"
    for name, entity in (("person", "PERSON"), ("location", "LOCATION"), ("org", "ORG")):
        sql[f"detect_{name}"] = sql["dictionary_occurrences"] + f" WHERE entity_type = '{entity}'"
    sql["sql_surface"] = f"""
SELECT 'site' AS part, {_SITE} AS name, host AS detail, count(*) AS n
FROM (SELECT {_HOST} AS host FROM pages) GROUP BY ALL
UNION ALL
SELECT 'tier', {_TIER}, {_decision(OVERRIDES)} || ' <' || entity_type || '_1>', count(*)
FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'LOCATION' ELSE upper(event_type) END
  AS entity_type FROM events) GROUP BY ALL
UNION ALL
SELECT 'luhn', valid::VARCHAR, o_orderstatus, count(*) FROM (SELECT o_orderstatus,
  list_sum(list_transform(string_split(reverse(lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 16, '4')), ''),
    lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4
      THEN c::INTEGER * 2 - 9 ELSE c::INTEGER * 2 END)) % 10 = 0 AS valid FROM orders) GROUP BY ALL"""
    sql["dictionary_joined"] = sql["dictionary_occurrences"]
    sql["language_profiles"] = _PROFILES
    sql["identify_language"] = _IDENTIFIED
    sql["normalise_lang"] = f"""
SELECT code, n, {_NORMALISED} AS lang FROM (SELECT code, n, {_SHORT} AS s FROM (
  SELECT code, count(*) AS n FROM (
    SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS code FROM documents)
  WHERE length(code) = 3 GROUP BY code))"""
    sql["find_spans"] = (
        'SELECT scope_id, seq, "start", "end", value FROM ('
        + _located(DOCUMENTS, "[A-Za-z]*[0-9]+") + ")"
    )
    sql["resolve_overlaps"] = _with(CORPUS) + f"SELECT {_COLUMNS} FROM kept"
    sql["resolve_overlaps_exploded"] = sql["resolve_overlaps"]
    sql["overlap_pairs"] = _with(
        CORPUS,
        placed='SELECT *, row_number() OVER (PARTITION BY scope_id, seq ORDER BY "start", "end", det_ord, entity_type) AS pos FROM raw',
    ) + """
SELECT scope_id, seq, a.entity_type AS entity_a, a."start" AS start_a, a."end" AS end_a,
  b.entity_type AS entity_b, b."start" AS start_b, b."end" AS end_b
FROM placed a JOIN placed b USING (scope_id, seq)
WHERE a.pos < b.pos AND a."start" < b."end" AND b."start" < a."end\""""
    sql["shadowed_spans"] = _with(CORPUS) + """
SELECT scope_id, seq, r.entity_type, r."start", r."end",
  (r."end" - r."start" - coalesce(sum(least(r."end", k."end") - greatest(r."start", k."start")), 0))::INTEGER AS clear_chars
FROM raw r LEFT JOIN (SELECT scope_id, seq, "start", "end" FROM kept) k
  ON r.scope_id = k.scope_id AND r.seq = k.seq AND r."start" < k."end" AND k."start" < r."end"
GROUP BY r.scope_id, r.seq, r.entity_type, r."start", r."end", r.det_ord
HAVING clear_chars > 0""".replace("SELECT scope_id, seq, r.entity", "SELECT r.scope_id, r.seq, r.entity")
    sql["policy_table"] = _with(
        CORPUS, counts="SELECT entity_type, count(*) AS n FROM kept GROUP BY 1"
    ) + f"""
SELECT entity_type, label, tier,
  CASE tier WHEN 'high' THEN 'auto_scrub' WHEN 'medium' THEN 'warn' ELSE 'notify' END AS default_action,
  {_OVERRIDE} AS override_action, {_decision(OVERRIDES)} AS effective_action,
  coalesce(n, 0) AS n_spans
FROM (VALUES {_LABELS}) c(entity_type, label, tier) LEFT JOIN counts USING (entity_type)"""
    sql["entity_tier"] = _with(CORPUS) + f"""
SELECT entity_type, count(*) AS n, {_TIER} AS tier
FROM (SELECT entity_type FROM kept UNION ALL SELECT upper(event_type) FROM events) GROUP BY entity_type"""
    sql["top_tier"] = _per_message(f"{_TOP} AS top_tier")
    sql["decision_matrix"] = _with(CORPUS) + f"""
SELECT entity_type, {_TIER} AS tier, {_decision(policy.Settings('strict'))} AS strict,
  {_decision(policy.Settings('permissive'))} AS permissive, count(*) AS n_spans
FROM kept GROUP BY entity_type"""
    for name, settings in (
        ("strict", policy.Settings("strict")),
        ("permissive", policy.Settings("permissive")),
        ("override", OVERRIDES),
    ):
        sql[f"message_decision_{name}"] = _per_message(
            f"{_message_decision(settings)} AS decision"
        )
    vault_columns = "scope_id, entity_type, value, first_seq, first_start, idx, token"
    sql["token_vault_session"] = _with(CORPUS) + f"SELECT {vault_columns} FROM ({_vault()})"
    sql["token_vault_corpus"] = _with(ONE_SCOPE) + f"SELECT {vault_columns} FROM ({_vault()})"
    sql["vault_append"] = _with(
        ONE_SCOPE,
        earlier=_vault("(SELECT * FROM kept WHERE seq % 3 <> 2)"),
        fresh=_vault(
            "(SELECT * FROM kept WHERE (scope_id, entity_type, value) NOT IN"
            " (SELECT (scope_id, entity_type, value) FROM earlier))"
        ),
        last="SELECT scope_id, entity_type, max(idx) AS last FROM earlier GROUP BY 1, 2",
    ) + """
SELECT scope_id, entity_type, value, first_seq, first_start, idx + coalesce(last, 0) AS idx,
  '<' || entity_type || '_' || (idx + coalesce(last, 0))::VARCHAR || '>' AS token
FROM fresh LEFT JOIN last USING (scope_id, entity_type)"""
    sql["vault_size"] = (
        _with(CORPUS) + f"SELECT scope_id, count(*) AS vault_size FROM ({_vault()}) GROUP BY 1"
    )
    sql["token_vault_epochs"] = _with(
        CORPUS,
        epochs=_EPOCHS,
        scoped="SELECT kept.* REPLACE (scope_id || '#' || epoch::VARCHAR AS scope_id)"
        " FROM kept JOIN epochs USING (scope_id, seq)",
    ) + f"SELECT {vault_columns} FROM ({_vault('scoped')})"
    sql["scrub_document"] = _SCRUB_DOCUMENT
    session = dict(
        vault=_vault(),
        spliced="SELECT kept.*, token FROM kept JOIN vault USING (scope_id, entity_type, value)",
    )
    sql["scrub_session"] = _with(CORPUS, **session) + _SCRUBBED
    sql["restore_text"] = _with(CORPUS, vault=_vault()) + """
SELECT m.scope_id, m.seq, m.text || ' see ' || coalesce(v.value, '<PHONE_NUMBER_1>') || ' or <PERSON_99>' AS restored
FROM m SEMI JOIN kept USING (scope_id, seq)
LEFT JOIN (SELECT scope_id, value FROM vault WHERE token = '<PHONE_NUMBER_1>') v USING (scope_id)"""
    sql["restore_text_hard"] = _with(
        CORPUS,
        vault=_vault(),
        spliced="SELECT kept.*, CASE WHEN seq % 11 = 0 OR idx % 5 = 0 THEN token ELSE value END AS token"
        " FROM kept JOIN vault USING (scope_id, entity_type, value)",
        done=_SCRUBBED,
    ) + """
SELECT CASE WHEN d.seq % 11 <> 0 THEN d.scope_id END AS scope_id,
  CASE WHEN d.seq % 13 <> 0 THEN d.seq // 3 END AS seq, d.seq AS row,
  scrubbed || ' see ' || coalesce(CASE WHEN d.seq % 11 <> 0 THEN v.value END, '<PHONE_NUMBER_1>') AS restored
FROM done d LEFT JOIN (SELECT scope_id, value FROM vault WHERE token = '<PHONE_NUMBER_1>') v
  ON v.scope_id = d.scope_id"""
    quoted = """
SELECT 'seg-' || c_mktsegment AS scope_id, c_custkey AS seq, 'about <SSN_' || (c_custkey % 500)::VARCHAR
  || '> and <PERSON_' || c_custkey::VARCHAR || '> please' AS text FROM customer"""
    literal = f"SELECT scope_id, seq, text FROM ({DOCUMENTS}) UNION ALL {quoted}"
    sql["literal_token_collisions"] = _with(CORPUS, vault=_vault()) + f"""
SELECT scope_id, seq, t."start", t.value AS token, vault.value AS vault_value
FROM ({_located(literal, P.TOKEN)}) t
JOIN vault USING (scope_id) WHERE vault.token = t.value"""
    sql["analyze"] = _per_message(_ANALYSED)
    sql["analyze_with_dictionary"] = _with(
        CORPUS,
        more=f"SELECT {_COLUMNS} FROM raw UNION ALL SELECT {_COLUMNS} FROM ({_named('FROM m')})",
    ) + f"SELECT {_COLUMNS} FROM ({_resolved('more')})"
    sql["disposition"] = (
        _with(CORPUS) + f"SELECT scope_id, seq, decision, action, outcome FROM ({_DISPOSED})"
    )
    sql["send_pipeline"] = _with(
        CORPUS,
        disposed=_DISPOSED,
        released="SELECT kept.* FROM kept SEMI JOIN (SELECT * FROM disposed"
        " WHERE outcome = 'sent_scrubbed') USING (scope_id, seq)",
        vault=_vault("released"),
        spliced="SELECT released.*, token FROM released JOIN vault USING (scope_id, entity_type, value)",
        done=_SCRUBBED,
    ) + """
SELECT scope_id, seq, outcome, CASE WHEN outcome <> 'held' THEN coalesce(scrubbed, text) END AS delivered
FROM disposed LEFT JOIN done USING (scope_id, seq)"""
    sql["send_write"] = sql["send_pipeline"]
    key = """CASE WHEN seq % 11 <> 0 THEN scope_id END AS scope_id,
  CASE WHEN seq % 13 = 0 THEN NULL WHEN seq % 17 = 0 THEN seq + 1 ELSE seq END AS seq"""
    sql["scrub_session_hard"] = _with(
        CORPUS,
        hits=f"SELECT scope_id || '#' || seq::VARCHAR AS id, seq AS row, text, {key}"
        " FROM m SEMI JOIN kept USING (scope_id, seq)",
        placed='SELECT hits.scope_id, hits.seq, entity_type, value, "start", "end", id, row FROM hits'
        " JOIN kept ON hits.id = kept.scope_id || '#' || kept.seq::VARCHAR"
        " WHERE hits.scope_id IS NOT NULL AND hits.seq IS NOT NULL",
        earlier=_vault("(SELECT * FROM placed WHERE seq % 2 = 0)"),
        fresh=_vault(
            "(SELECT * FROM placed WHERE (scope_id, entity_type, value) NOT IN"
            " (SELECT (scope_id, entity_type, value) FROM earlier))"
        ),
        last="SELECT scope_id, entity_type, max(idx) AS last FROM earlier GROUP BY 1, 2",
        vault="SELECT scope_id, entity_type, value, token FROM earlier UNION ALL"
        " SELECT scope_id, entity_type, value, '<' || entity_type || '_'"
        " || (idx + coalesce(last, 0))::VARCHAR || '>' FROM fresh LEFT JOIN last USING (scope_id, entity_type)",
        spliced='SELECT id, p."start", p."end", hits.text, token,'
        ' coalesce(lag(p."end") OVER (PARTITION BY id ORDER BY p."start"), 0) AS prev'
        " FROM placed p JOIN vault USING (scope_id, entity_type, value) JOIN hits USING (id)",
        done="""SELECT id, string_agg(substr(text, prev + 1, "start" - prev) || token, '' ORDER BY "start")
  || substr(any_value(text), max("end") + 1) AS scrubbed FROM spliced GROUP BY id""",
        alone="SELECT scope_id, seq FROM hits GROUP BY 1, 2 HAVING count(*) = 1",
    ) + """
SELECT hits.scope_id, hits.seq, row, CASE WHEN alone.seq IS NOT NULL THEN scrubbed END AS scrubbed
FROM hits LEFT JOIN done USING (id)
LEFT JOIN alone ON alone.scope_id = hits.scope_id AND alone.seq = hits.seq"""
    sql["analyze_with_language"] = _per_message(
        "any_value(lang) AS lang, count(entity_type)::INTEGER AS n_detections, "
        f"{_TOP} AS top_tier, {_message_decision(policy.DEFAULT_SETTINGS)} AS decision",
        _TEXTS_WITH_LANG,
    )
    open_docs = DOCUMENTS + " WHERE lang <> 'de' AND length(text) <= 5000"
    sql["fail_closed"] = _with(open_docs) + f"""
SELECT scope_id, seq, FALSE AS failed, count(entity_type)::INTEGER AS n_detections, {_TOP} AS top_tier,
  {_message_decision(policy.Settings('permissive'))} AS decision
FROM m LEFT JOIN kept USING (scope_id, seq) GROUP BY scope_id, seq
UNION ALL SELECT source, doc_id, TRUE, 0, 'high', 'block' FROM documents
WHERE lang = 'de' OR length(text) > 5000"""
    fragment_keys = "scope_id, seq, part"
    by_part = _FRAGMENTS
    # The spans are worked out on (document#part) so that all SQL above applies.
    as_scope = (
        "SELECT scope_id || '#' || part::VARCHAR AS scope_id, seq, text, lang"
        f" FROM ({by_part})"
    )
    sql["fragment_scan"] = _with(
        as_scope,
        more=f"SELECT {_COLUMNS} FROM raw UNION ALL SELECT {_COLUMNS} FROM ({_named('FROM m')})",
        best=_resolved("more"),
        decided=f"""
SELECT scope_id, seq, {_TOP} AS top_tier, {_message_decision(policy.DEFAULT_SETTINGS)} AS decision,
  coalesce(array_to_string(list_distinct_ordered, ', '), '') AS entities
FROM m LEFT JOIN best USING (scope_id, seq)
LEFT JOIN (SELECT scope_id, seq, list(entity_type ORDER BY o) AS list_distinct_ordered FROM (
    SELECT scope_id, seq, entity_type, min({{'a': -score, 'b': -length(value), 'c': det_ord, 'd': "start"}}) AS o
    FROM best GROUP BY 1, 2, 3) GROUP BY 1, 2) e USING (scope_id, seq)
GROUP BY scope_id, seq, list_distinct_ordered""",
    ) + """
SELECT string_split(scope_id, '#')[1] AS scope_id, seq, string_split(scope_id, '#')[2]::INTEGER AS part,
  top_tier, decision, entities, CASE WHEN decision IN ('allow', 'notify') THEN ''
    WHEN top_tier = 'high' THEN 'scrub,edit' ELSE 'scrub,edit,send' END AS offered
FROM decided"""
    del fragment_keys
    sql["entity_summary"] = _with(CORPUS) + """
SELECT m.scope_id, m.seq, coalesce(entities, '') AS entities FROM m LEFT JOIN (
  SELECT scope_id, seq, string_agg(entity_type, ', ' ORDER BY o) AS entities FROM (
    SELECT scope_id, seq, entity_type, min({'a': -score, 'b': -length(value), 'c': det_ord, 'd': "start"}) AS o
    FROM kept GROUP BY 1, 2, 3) GROUP BY 1, 2) e USING (scope_id, seq)"""
    sql["entity_counts"] = _with(CORPUS) + """
SELECT scope_id, seq, entity_type, count(*)::INTEGER AS n,
  entity_type || CASE WHEN count(*) > 1 THEN ' ×' || count(*)::VARCHAR ELSE '' END AS label,
  count(*)::VARCHAR || CASE WHEN count(*) = 1 THEN ' item' ELSE ' items' END || ' scrubbed' AS notice
FROM kept GROUP BY 1, 2, 3"""
    counted = "coalesce(sum(n) FILTER (outcome = 'sent_scrubbed'), 0)::BIGINT AS scrub_count"
    sql["scrub_count"] = (
        _with(CORPUS, disposed=_DISPOSED) + f"SELECT scope_id, {counted} FROM disposed GROUP BY 1"
    )
    sql["scrub_count_epochs"] = (
        _with(CORPUS, disposed=_DISPOSED, epochs=_EPOCHS)
        + f"SELECT scope_id, epoch, {counted} FROM disposed JOIN epochs USING (scope_id, seq) GROUP BY 1, 2"
    )
    sql["exposure_rollup"] = _with(CORPUS) + f"""
SELECT entity_type, {_TIER} AS tier, source, lang, count(*) AS n_spans,
  count(DISTINCT value) AS n_values, count(DISTINCT (scope_id, seq)) AS n_messages
FROM kept JOIN (SELECT scope_id, seq, lang FROM m) USING (scope_id, seq) GROUP BY entity_type, source, lang"""
    sql["site_attribution"] = f"SELECT visit_id, host, {_SITE} AS site FROM ({_VISITED})"
    sql["site_popup_match"] = f"SELECT visit_id, host, {_POPUP} AS popup_site FROM ({_VISITED})"
    exact = "coalesce(host IN (" + ", ".join(_s(h) for h, _ in routing.SITES) + "), FALSE)"
    sql["site_coverage"] = f"""
SELECT *, (site <> 'generic') <> covered AS disagrees FROM (
  SELECT host, {_SITE} AS site, {exact} AS covered, count(*) AS n_visits
  FROM ({_VISITED}) GROUP BY host)"""
    sql["audit_no_leak"] = _KEPT_SCRUBBED + _summary(
        "SELECT * FROM kept JOIN done USING (scope_id, seq)", "contains(scrubbed, value)"
    )
    sql["audit_span_integrity"] = _with(CORPUS) + _summary(
        "SELECT * FROM kept JOIN m USING (scope_id, seq)",
        'substr(text, "start" + 1, "end" - "start") <> value',
    )
    faulty = dict(
        session,
        done=_SCRUBBED,
        sent="SELECT done.scope_id, done.seq, text,"
        " CASE WHEN seq % 50 = 0 THEN text ELSE scrubbed END AS scrubbed"
        " FROM done JOIN m USING (scope_id, seq)",
    )
    leaks = _summary("SELECT * FROM kept JOIN sent USING (scope_id, seq)", "contains(scrubbed, value)")
    changed = _summary("SELECT * FROM sent", "seq % 50 = 0")
    sql["audit_session"] = _with(CORPUS, **faulty) + (
        f"SELECT 'no_leak' AS audit, * FROM ({leaks}) UNION ALL SELECT 'preserve', * FROM ({changed})"
    )
    sql["audit_round_trip_session"] = _with(
        CORPUS,
        vault=_vault(),
        spliced="SELECT kept.*, back.value AS token FROM kept JOIN vault USING (scope_id, entity_type, value)"
        " JOIN (SELECT scope_id AS s, token AS t, value FROM vault) back ON s = scope_id AND t = token",
        done=_SCRUBBED,
    ) + _summary(
        "SELECT done.scrubbed AS restored, m.text, seq FROM done JOIN m USING (scope_id, seq)",
        "restored <> text OR seq % 50 = 0",
    )
    sql["audit_scope_leak"] = _with(
        f"{DOCUMENTS} UNION ALL {CUSTOMERS}",
        **session,
        done=_SCRUBBED,
        sent="SELECT scope_id, seq, CASE WHEN seq % 50 = 0 THEN text ELSE coalesce(scrubbed, text) END AS scrubbed"
        " FROM m LEFT JOIN done USING (scope_id, seq)",
    ) + """
SELECT scope_id, seq, entity_type, token FROM sent JOIN vault USING (scope_id) WHERE contains(scrubbed, value)"""
    sql["scrub_skip_allowed"] = _with(
        CORPUS,
        wanted=f"SELECT * FROM kept WHERE {_decision(OVERRIDES)} <> 'allow'",
        vault=_vault("wanted"),
        spliced="SELECT wanted.*, token FROM wanted JOIN vault USING (scope_id, entity_type, value)",
    ) + _SCRUBBED
    sql["audit_overlap"] = _with(CORPUS) + _summary(
        'SELECT *, lag("end") OVER (PARTITION BY scope_id, seq ORDER BY "start", "end") AS left_end FROM kept',
        'left_end > "start"',
    )
    sql["audit_round_trip"] = "SELECT count(*) AS checked, 0::BIGINT AS violations FROM (" + CORPUS + ")"
    sql["audit_preserve"] = _KEPT_SCRUBBED + _summary(
        """SELECT *, coalesce(outside, text) AS o, coalesce(scrubbed, text) AS s FROM m
LEFT JOIN done USING (scope_id, seq)
LEFT JOIN (SELECT scope_id, seq, string_agg(substr(text, prev + 1, "start" - prev), '' ORDER BY "start")
    || substr(any_value(text), max("end") + 1) AS outside
  FROM (SELECT s.*, m.text, coalesce(lag("end") OVER (PARTITION BY scope_id, seq ORDER BY "start"), 0) AS prev
    FROM spliced s JOIN m USING (scope_id, seq)) GROUP BY scope_id, seq) USING (scope_id, seq)""",
        f"o <> regexp_replace(s, {_s(P.TOKEN)}, '', 'g')",
    )
    sql["stream_analyze"] = _per_message(_ANALYSED, DOCUMENTS)
    sql["stream_tokenise"] = _with(DOCUMENTS) + f"SELECT {vault_columns} FROM ({_vault()})"
    sql["stream_vault"] = sql["stream_tokenise"]
    sql["stream_known_vault"] = sql["stream_tokenise"]
    sql["stream_sessions"] = f"""
WITH gaps AS (
  SELECT 'user' || user_id::VARCHAR AS scope_id, event_id, ts, upper(event_type) AS entity_type, props AS value,
    coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {C.SESSION_GAP * 1_000_000},
      TRUE) AS opens FROM events
), numbered AS (
  SELECT *, sum(opens::INTEGER) OVER (PARTITION BY scope_id ORDER BY ts, event_id) AS session FROM gaps
), named AS (
  SELECT *, first_value(event_id) OVER (PARTITION BY scope_id, session ORDER BY ts, event_id) AS session_seq FROM numbered
), firsts AS (
  SELECT scope_id, session_seq, entity_type, value, arg_min(event_id, (ts, event_id)) AS first_seq,
    min((ts, event_id)) AS place FROM named GROUP BY ALL
)
SELECT scope_id, session_seq, entity_type, value, first_seq, idx,
  '<' || entity_type || '_' || idx::VARCHAR || '>' AS token
FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, session_seq, entity_type ORDER BY place) AS idx FROM firsts)"""
    sql["stream_scrub"] = _with(
        DOCUMENTS,
        decided=f"SELECT scope_id, seq, any_value(text) AS text,"
        f" {_message_decision(policy.Settings('permissive'))} AS decision"
        " FROM m LEFT JOIN kept USING (scope_id, seq) GROUP BY scope_id, seq",
        disposed=f"SELECT *, CASE WHEN NOT regexp_matches(text, {_s('[^' + P.SPACE + ']')})"
        " OR decision IN ('allow', 'notify') THEN 'sent_raw'"
        " WHEN decision = 'auto_scrub' THEN 'sent_scrubbed' ELSE 'held' END AS outcome FROM decided",
        released="SELECT kept.* FROM kept SEMI JOIN (SELECT * FROM disposed"
        " WHERE outcome = 'sent_scrubbed') USING (scope_id, seq)",
        vault=_vault("released"),
        spliced="SELECT released.*, token FROM released JOIN vault USING (scope_id, entity_type, value)",
        done=_SCRUBBED,
    ) + """
SELECT scope_id, seq, outcome, CASE WHEN outcome <> 'held' THEN coalesce(scrubbed, text) END AS delivered
FROM disposed LEFT JOIN done USING (scope_id, seq)"""
    sql["stream_scrub_count"] = _with(DOCUMENTS) + f"""
SELECT scope_id, coalesce(sum(n) FILTER (decision = 'auto_scrub'), 0)::BIGINT AS scrub_count
FROM (SELECT scope_id, seq, count(entity_type) AS n,
    {_message_decision(policy.Settings('permissive'))} AS decision
  FROM m LEFT JOIN kept USING (scope_id, seq) GROUP BY 1, 2) GROUP BY 1"""
    return sql
