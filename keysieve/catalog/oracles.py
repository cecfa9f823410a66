"""The same queries as plain SQL for DuckDB, whose regular expressions are RE2.

Rules are used as they are written, without translation; only the rules with a
secret inside the match are cut by hand.
"""

from __future__ import annotations

import re

from keysieve.catalog.corpus import DUCKDB_FILES, DUCKDB_PATCHES, LEAKS_SQL
from keysieve.catalog.queries import OWN_RULES, merged_rules
from keysieve.operators.verify import AWS_REJECTIONS, PROVIDERS, SECRET_KEY, SECRET_KEY_HINT
from keysieve.sources.rulesets import RuleSet, default_rules, rules_from_text

# The patterns of two rules with text around the secret, with captures
# for what stands before and after it added, so that SQL can tell the three apart.
BY_HAND = {
    "generic-api-key": (
        r"""(?i)((?:access|auth|(?-i:[Aa]pi|API)|credential|creds|key|passw(?:or)?d|secret|token)[\w.-]{0,50}?(?:[ \t\w.-]{0,20})[\s"']{0,3}(?:=|>|:{1,3}=|\|\||:|=>|\?=|,)[\x60"'\s=]{0,5})([\w.=-]{10,150}|[a-z0-9][a-z0-9+/]{11,}={0,3})((?:[\x60"'\s;]|\\[nr]|$))""",
        r"\1", r"\2", r"\3",
    ),
    "connection-string": (
        r"""([a-zA-Z][a-zA-Z0-9+\-.]{1,30}://[^:@\s]*:)([^@\s]+)(@[^\s/"']+)""", r"\1", r"\2", r"\3",
    ),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cut(rule) -> tuple[str, str, str, str]:
    if rule.id in BY_HAND:
        return BY_HAND[rule.id]
    if rule.id == "labelled-id":  # the secret is the last repetition's capture
        return (
            r"(id(?:[ x]+AKIA[A-Z0-9]{16})*[ x]+AKIA)([A-Z0-9]{16})()", r"\1", r"\2", r"\3",
        )
    if rule.id == "own-aws":
        return r"(id )(AKIA[A-Z0-9]{16})()", r"\1", r"\2", r"\3"
    if "(" in rule.regex.replace("(?", "") and rule.group == 1:
        return rule.regex, "", r"\1", ""
    return f"({rule.regex})", "", r"\1", ""


def gate_sql(rule, line: str) -> str:
    return " OR ".join(f"contains(lower({line}), {q(k.lower())})" for k in rule.keywords)


def any_gate(ruleset: RuleSet, line: str) -> str:
    return " OR ".join(gate_sql(r, line) for r in ruleset.rules)


def any_of(value: str, patterns) -> str:
    return " OR ".join(f"regexp_matches({value}, {q(p)})" for p in patterns) or "false"


def ctes(source: str, ruleset: RuleSet | None = None, entropy: bool = True) -> str:
    """``matches`` (gate and pattern), ``kept`` (entropy), ``finding`` records.

    ``source`` is a relation with path, line_no and line; its other columns are
    carried along.
    """
    ruleset = ruleset or default_rules()
    cuts = []
    for ordinal, rule in enumerate(ruleset.rules):
        pattern, before, secret, after = cut(rule)
        marked = "||".join(["chr(10)", q(before), "chr(10)", q(secret), "chr(10)", q(after), "chr(10)"])
        cuts.append(
            f"SELECT s.*, {ordinal} AS rule_ord, {q(rule.id)} AS rule_id,"
            f" {rule.entropy}::DOUBLE AS threshold, {str(rule.is_heuristic).lower()} AS heuristic,"
            f" string_split(regexp_replace(line, {q(pattern)}, {marked}, 'g'), chr(10)) AS p"
            f" FROM {source} s WHERE {gate_sql(rule, 'line')}"
        )
    own = " OR ".join(
        f"(rule_id = {q(r.id)} AND ({any_of('value', [p for a in r.allowlists for p in a.regexes])}))"
        for r in ruleset.rules
        if r.allowlists
    )
    values = any_of("value", [p for a in ruleset.allowlists for p in a.regexes])
    paths = any_of("path", [p for a in ruleset.allowlists for p in a.paths])
    gate = "threshold = 0 OR entropy > threshold" if entropy else "true"
    blob = "'****...****'"
    return f"""
cuts AS ({' UNION ALL '.join(cuts)}),
hits AS (SELECT *, unnest(range(0, CAST((len(p) - 1) // 4 AS BIGINT))) AS i FROM cuts WHERE len(p) > 1),
matches AS (
  SELECT * EXCLUDE (p, i), p[4*i+2] AS before, p[4*i+3] AS value, p[4*i+4] AS after,
         CAST(1 + list_sum(list_transform(p[1:4*i+2], lambda x: strlen(x))) AS INTEGER) AS col
  FROM hits WHERE p[4*i+3] <> ''),
scored AS (
  SELECT *, list_sum(list_transform(list_distinct(string_split(value, '')),
    lambda c: -(len(list_filter(string_split(value, ''), lambda x: x = c)) / strlen(value))
              * log2(len(list_filter(string_split(value, ''), lambda x: x = c)) / strlen(value)))) AS entropy
  FROM matches),
kept AS (SELECT * FROM scored WHERE {gate}),
allowed AS (SELECT *, (({values}) OR ({paths}) OR ({own or 'false'})) AS allowed FROM kept),
shown AS (
  SELECT *, CASE WHEN strlen(value) < 16 THEN '[REDACTED]'
    ELSE decode(encode(value)[1:4]) || {blob} || decode(encode(value)[-4:]) END AS secret,
    replace(path, '\\', '/') || ':' || rule_id || ':' || substr(sha256(value), 1, 16) AS fingerprint,
    regexp_extract(line, '(?i)scan:ignore\\b(?::([a-zA-Z0-9_,-]+))?', 1) AS scope,
    regexp_matches(line, '(?i)scan:ignore\\b') AS directive
  FROM allowed WHERE NOT allowed),
found AS (
  SELECT *, directive AND (scope = '' OR list_contains(string_split(scope, ','), rule_id)) AS hidden,
         array_to_string(string_split(fingerprint, ':')[-2:], ':') AS content_key
  FROM shown)"""


def finding_columns(commit: bool) -> str:
    def meta(name: str) -> str:
        return f"{name}" if commit else f"CAST(NULL AS VARCHAR) AS {name}"

    return (
        'rule_id, path AS file, CAST(line_no AS INTEGER) AS line, col AS "column",'
        " before || secret || after AS match, secret, fingerprint,"
        " CASE WHEN heuristic THEN true END AS is_heuristic, CASE WHEN hidden THEN true END AS suppressed,"
        " CASE WHEN hidden THEN 'inline-ignore' END AS suppression_reason,"
        f" {meta('commit_sha')}, {meta('commit_author')}, {meta('commit_date')}"
    )


COMMIT = finding_columns(True)
PLAIN = finding_columns(False)
LEAKS = f"leaks AS ({LEAKS_SQL})"
ON_LEAKS = f"WITH {LEAKS}, {ctes('leaks').strip()}"
DOC_TEXTS = (
    "texts AS (SELECT concat(source, '/', lang, '/', cast(doc_id AS string), '.txt') AS path, text FROM documents)"
)
LINES = """
parts AS (SELECT path, string_split(text, chr(10)) AS l FROM texts),
numbered AS (
  SELECT path, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS line_no, unnest(l) AS line, len(l) AS n FROM parts),
lines AS (
  SELECT path, CAST(line_no AS INTEGER) AS line_no,
         CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS line
  FROM numbered WHERE line_no < n OR line <> '')"""

# --- paths ------------------------------------------------------------------

# The names that are excluded by default, as one pattern each.
EXCLUDED_FOLDER = r"^(?:.*/)?(?:vendor|node_modules|dist|build)(?:/.*)?$"
EXCLUDED_FILE = (
    r"^(?:.*/)?(?:[^/]*\.min\.js|[^/]*\.min\.css|[^/]*\.map|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock"
    r"|pnpm-lock\.yaml|go\.sum|Gemfile\.lock|poetry\.lock|Pipfile\.lock|composer\.lock|Cargo\.lock)$"
)


def excluded_by(path: str) -> str:
    folders = (
        f"list_filter(list_transform(range(1, CAST(len(string_split({path}, '/')) AS BIGINT)),"
        f" lambda n: array_to_string(string_split({path}, '/')[1:n], '/')),"
        f" lambda d: regexp_matches(d, {q(EXCLUDED_FOLDER)}) OR regexp_matches(d, {q(EXCLUDED_FILE)}))[1]"
    )
    return (
        f"coalesce({folders}, CASE WHEN regexp_matches({path}, {q(EXCLUDED_FOLDER)})"
        f" OR regexp_matches({path}, {q(EXCLUDED_FILE)}) THEN {path} END)"
    )


PATHS = f"WITH {LEAKS}, paths AS (SELECT DISTINCT path FROM leaks), ex AS (SELECT path, {excluded_by('path')} AS excluded_by FROM paths)"

FILES = f"""
rows AS ({DUCKDB_FILES}),
manifest AS (
  SELECT root_ord, abs_path, path, first_id, size, body, error FROM rows
  UNION ALL
  SELECT 2, abs_path, substr(path, length(string_split(path, '/')[1]) + 2), first_id, size, body, error
  FROM rows WHERE first_id % 13 IN (5, 8)),
chosen AS (
  SELECT *, {excluded_by('path')} AS excluded_by FROM manifest),
status0 AS (
  SELECT *, CASE WHEN excluded_by IS NOT NULL THEN 'excluded' WHEN size > 10485760 THEN 'oversized'
              ELSE 'selected' END AS s0 FROM chosen),
status1 AS (
  SELECT *, min(CASE WHEN s0 = 'selected' THEN root_ord END) OVER (PARTITION BY abs_path) AS first_root FROM status0),
files AS (
  SELECT *, CASE WHEN s0 <> 'selected' THEN s0 WHEN root_ord > first_root THEN 'duplicate'
              WHEN error IS NOT NULL THEN 'unreadable'
              WHEN strpos(left(body, 512), chr(0)) > 0 THEN 'binary' ELSE 'scanned' END AS status FROM status1)"""
OPEN_FILES = FILES.replace("WHEN size > 10485760 THEN 'oversized'", "").replace(
    "WHEN strpos(left(body, 512), chr(0)) > 0 THEN 'binary'", ""
)  # without limits
ON_OPEN_FILES = f"WITH {LEAKS}, {OPEN_FILES}, texts AS (SELECT path, body AS text FROM files WHERE status = 'scanned'), {LINES}"
ON_FILES = f"WITH {LEAKS}, {FILES}, texts AS (SELECT path, body AS text FROM files WHERE status = 'scanned'), {LINES}"
COUNTERS = """count(*) FILTER (status = 'scanned') AS files_scanned,
  count(DISTINCT CASE WHEN status = 'excluded' THEN concat(root_ord, '|', excluded_by) END) AS paths_excluded,
  count(*) FILTER (status = 'unreadable') AS files_unreadable,
  count(*) FILTER (status = 'oversized') AS files_oversized,
  count(*) FILTER (status = 'binary') AS files_binary"""

# --- patches ----------------------------------------------------------------
# What the patches add, stated from the way they were built.
ADDED = f"""
patches AS ({DUCKDB_PATCHES}),
lines AS (
  SELECT path, CASE WHEN event_id % 10 = 0 THEN line_no + 1 ELSE line_no END AS line_no, line,
         1000000000 - event_id AS seq, commit_sha, commit_author, commit_date, event_id FROM leaks
  UNION ALL
  SELECT path, 77, '', 2000000000 - event_id, concat('0', substr(commit_sha, 2)), 'first author',
         concat('2020-', substr(commit_date, 6)), event_id FROM leaks WHERE event_id % 24 = 22
  UNION ALL
  SELECT path, 78, line, 2000000000 - event_id, concat('0', substr(commit_sha, 2)), 'first author',
         concat('2020-', substr(commit_date, 6)), event_id FROM leaks WHERE event_id % 24 = 22)"""
ON_PATCHES = f"WITH {LEAKS}, {ADDED}, {ctes('lines').strip()}"


def dedup(strict: bool, live_only: bool = False, commit: bool = True) -> str:
    first = "(hidden, seq, line_no, col)" if strict or live_only else "(seq, line_no, col)"
    date = "commit_date" if commit else "CAST(NULL AS VARCHAR)"
    place = f"({'hidden, ' if live_only else ''}{date} IS NULL, {date}, {first})"
    picked = ", ".join(
        f"first({c} ORDER BY {first}) AS {c}" for c in ("rule_id", "path", "before", "after", "secret", "heuristic", "hidden")
    )
    meta = ("commit_sha", "commit_author", "commit_date")
    placed = ", ".join(
        f"first({c} ORDER BY {place}) AS {c}" for c in ("line_no", "col", *(meta if commit else ()))
    )
    return f"""dd AS (
  SELECT fingerprint, {picked}, {placed}, CAST(sum(CASE WHEN hidden THEN 1 ELSE 0 END) AS BIGINT) AS inline_hits
  FROM found GROUP BY fingerprint)"""


# --- baseline, report, verification -------------------------------------------

BASELINE = f"""{ON_LEAKS},
base AS (SELECT DISTINCT content_key FROM found WHERE event_id % 3 = 0 AND NOT hidden),
marked AS (SELECT f.*, b.content_key IS NOT NULL AS known FROM found f LEFT JOIN base b USING (content_key))"""
REASON = "CASE WHEN hidden THEN 'inline-ignore' WHEN known THEN 'baseline' END"

FILE_SCAN = f"""{ON_FILES},
bt AS (SELECT path, body AS text FROM manifest WHERE first_id % 3 = 0 AND error IS NULL),
bparts AS (SELECT path, string_split(text, chr(10)) AS l FROM bt),
bnum AS (SELECT path, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS line_no, unnest(l) AS line, len(l) AS n FROM bparts),
every AS (
  SELECT path, line_no, line, 0 AS side FROM lines
  UNION ALL
  SELECT path, CAST(line_no AS INTEGER),
         CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END, 1
  FROM bnum WHERE line_no < n OR line <> ''),
{ctes('every').strip()},
base AS (SELECT DISTINCT content_key FROM found WHERE side = 1 AND NOT hidden),
marked AS (
  SELECT f.*, b.content_key IS NOT NULL AS known FROM found f LEFT JOIN base b USING (content_key) WHERE side = 0),
result AS (
  SELECT *, {REASON} AS reason FROM marked),
counts AS (SELECT {COUNTERS} FROM files),
totals AS (
  SELECT count(*) FILTER (reason IS NULL) AS active, count(*) AS total,
         count(DISTINCT CASE WHEN reason IS NULL THEN path END) AS active_files,
         count(*) FILTER (reason = 'inline-ignore') AS inline_ignore,
         count(*) FILTER (reason = 'baseline') AS baselined FROM result)"""


def clean(text: str) -> str:
    safe = f"regexp_replace({text}, '[\\x00-\\x08\\x0A-\\x1F\\x7F\\x{{2028}}\\x{{2029}}]', '�', 'g')"
    return safe


PLACE = f"{clean('path')} || ':' || line_no || ':' || col"
CLOSING = """SELECT 3 AS section, 0 AS part, CASE WHEN active > 0
    THEN format('⚠ {} finding(s) in {} file(s) · scanned {} files · {}', active, active_files, files_scanned, DURATION)
    ELSE format('✓ no findings · scanned {} files · {}', files_scanned, DURATION) END AS value FROM totals, counts"""

PROVIDER = "CASE " + " ".join(f"WHEN rule_id = {q(r)} THEN {q(p)}" for r, p in PROVIDERS.items()) + " END"
PROBES = f"""{ON_LEAKS},
probes AS (SELECT DISTINCT {PROVIDER} AS provider, sha256(value) AS h FROM found WHERE NOT hidden AND {PROVIDER} IS NOT NULL)"""
RESPONSES = f"""{PROBES},
gh AS (
  SELECT h, attempt, (ascii(substr(h, 1, 1)) + ascii(substr(h, 2, 1)) * attempt) % 7 AS kind
  FROM probes, (VALUES (1), (2)) v(attempt) WHERE provider = 'github'),
gho AS (
  SELECT h, attempt, CASE
    WHEN kind = 0 THEN 'active' WHEN kind = 1 THEN 'inactive' WHEN kind = 2 THEN 'retry' WHEN kind = 3 THEN 'retry'
    WHEN kind = 4 AND ascii(substr(h, 3, 1)) % 2 = 0 THEN 'retry' WHEN kind IN (4, 5) THEN 'unknown'
    WHEN ascii(substr(h, 4, 1)) % 2 = 0 THEN 'unknown' ELSE 'active' END AS o FROM gh),
ghs AS (
  SELECT a.h, CASE WHEN a.o <> 'retry' THEN a.o WHEN b.o <> 'retry' THEN b.o ELSE 'unknown' END AS status
  FROM gho a JOIN gho b ON a.h = b.h AND a.attempt = 1 AND b.attempt = 2),
awss AS (
  SELECT h, CASE WHEN k < {len(AWS_REJECTIONS)} THEN 'inactive'
    WHEN k = 6 AND ascii(substr(h, 3, 1)) % 2 = 0 THEN 'unknown' WHEN k = 6 THEN 'active' ELSE 'unknown' END AS status
  FROM (SELECT h, (ascii(substr(h, 1, 1)) + ascii(substr(h, 2, 1))) % 8 AS k FROM probes WHERE provider = 'aws')),
answers AS (
  SELECT 'github' AS provider, h, status FROM ghs UNION ALL SELECT 'aws', h, status FROM awss WHERE h < 'c'),
checked AS (
  SELECT f.*, {PROVIDER} AS provider, a.status AS answer,
         f.fingerprint IN (SELECT fingerprint FROM found WHERE NOT hidden) AS live
  FROM found f LEFT JOIN answers a ON a.provider = {PROVIDER.replace('rule_id', 'f.rule_id')} AND a.h = sha256(f.value))"""
KEY_FILES = f"""{LEAKS},
kl AS (
  SELECT concat('keys/k', cast(cast(floor(event_id / 12) AS bigint) AS string)) AS path, event_id,
         line || CASE event_id % 4
           WHEN 0 THEN concat(chr(10), 'key ', commit_sha, substr(md5(path), 1, 8), ';')
           WHEN 1 THEN concat(chr(10), 'AWS_SECRET_ACCESS_KEY follows')
           WHEN 2 THEN concat(chr(10), 'blob ', commit_sha, substr(md5(path), 1, 8), 'abcdef', chr(10), chr(10), '''',
                              lower(concat(commit_sha, substr(md5(path), 1, 8))), '''')
           ELSE '' END AS text
  FROM leaks),
texts AS (SELECT path, string_agg(text, chr(10) ORDER BY event_id) AS text FROM kl GROUP BY path)"""
PAIRS = f"""
pl AS (SELECT path, string_split(text, chr(10)) AS l FROM texts),
pn AS (SELECT path, unnest(range(0, CAST(len(l) AS BIGINT))) AS row_at, unnest(l) AS line FROM pl),
hints AS (SELECT path, row_at FROM pn WHERE regexp_matches(line, {q(SECRET_KEY_HINT)})),
toks AS (
  SELECT path, row_at, unnest(range(0, CAST(len(t) AS BIGINT))) AS pos, unnest(t) AS token
  FROM (SELECT path, row_at, regexp_extract_all(line, {q(SECRET_KEY)}, 1) AS t FROM pn)),
pairs AS (
  SELECT path, first(token ORDER BY dist, row_at, pos) AS token FROM (
    SELECT t.path, t.token, t.row_at, t.pos, min(abs(t.row_at - h.row_at)) AS dist
    FROM toks t JOIN hints h USING (path) GROUP BY ALL) GROUP BY path)"""


def _oracles() -> dict[str, str]:
    default = default_rules()
    out: dict[str, str] = {}
    out["leak_findings"] = f"{ON_LEAKS} SELECT {COMMIT} FROM found"
    order = 'path, line_no, col, rule_id, fingerprint'
    out["findings_sorted"] = (
        f"{ON_LEAKS} SELECT row_number() OVER (ORDER BY {order}) AS row_no, path AS file, CAST(line_no AS INTEGER) AS line,"
        ' col AS "column", rule_id, fingerprint FROM found'
    )
    out["stream_findings"] = out["leak_findings"]
    out["doc_findings"] = f"WITH {DOC_TEXTS}, {LINES}, {ctes('lines').strip()} SELECT {PLAIN} FROM found"
    dense = (
        "dense AS (SELECT concat('dense/', cast(cast(floor(event_id / 1000) AS bigint) AS string)) AS path, 1 AS line_no,"
        " string_agg(line, ' ' ORDER BY event_id) AS line FROM leaks GROUP BY 1)"
    )
    out["dense_lines"] = f"WITH {LEAKS}, {dense}, {ctes('dense').strip()} SELECT {PLAIN} FROM found"
    out["rules_from_table_findings"] = f"{ON_LEAKS} SELECT rule_id, count(*) AS findings FROM found GROUP BY rule_id"
    globally = " OR ".join(any_of(column, [p for a in default.allowlists for p in getattr(a, kind)])
                           for column, kind in (("v", "regexes"), ("path", "paths")))
    out["indexed_findings"] = (
        f"{ON_LEAKS}, watched AS (SELECT event_id % 400 AS customer, 'Acct#' || event_id % 400 || '~' || (event_id % 9000 + 1000) AS v, path"
        " FROM leaks WHERE event_id % 24 = 21)"
        " SELECT rule_id, secret, count(*) AS findings FROM (SELECT rule_id, secret FROM found UNION ALL"
        " SELECT 'customer-' || customer, CASE WHEN strlen(v) < 16 THEN '[REDACTED]' ELSE left(v, 4) || '****...****' || right(v, 4) END"
        f" FROM watched WHERE customer IN (SELECT c_custkey FROM customer) AND NOT ({globally})) GROUP BY ALL"
    )
    out["keyword_gate"] = (
        f"WITH {DOC_TEXTS}, {LINES} SELECT path, line_no, md5(line) AS line_md5 FROM lines WHERE {any_gate(default, 'line')}"
    )
    out["rule_candidates"] = f"WITH {LEAKS} " + " UNION ALL ".join(
        f"SELECT event_id, {q(r.id)} AS rule_id FROM leaks WHERE {gate_sql(r, 'line')}" for r in default.rules
    )
    hit = 'event_id, rule_id, col AS "column"'
    out["regex_matches"] = (
        f"{ON_LEAKS} SELECT {hit}, sha256(value) AS secret_sha256,"
        " CAST(strlen(before || value || after) AS INTEGER) AS match_bytes FROM matches"
    )
    out["entropy_gate"] = f"{ON_LEAKS} SELECT {hit} FROM kept"
    out["entropy_off"] = (
        f"WITH {LEAKS}, {ctes('leaks', entropy=False).strip()} SELECT rule_id, count(*) AS findings FROM found GROUP BY rule_id"
    )
    out["secret_entropy"] = f"{ON_LEAKS} SELECT {hit}, round(entropy, 6) AS entropy FROM scored"
    without = ctes("leaks", entropy=False).strip()
    out["allowlist_filtered"] = f"WITH {LEAKS}, {without} SELECT {hit} FROM found"
    all_shown = without.replace("FROM allowed WHERE NOT allowed", "FROM allowed")
    out["redacted"] = (
        f"WITH {LEAKS}, {all_shown} SELECT {hit}, secret, before || secret || after AS by_span,"
        " replace(before || value || after, value, secret) AS by_search FROM found"
    )
    out["fingerprints"] = (
        f"WITH {LEAKS}, {all_shown} SELECT {hit}, fingerprint, left(commit_sha, 7) AS short_sha FROM found"
    )
    out["content_keys"] = (
        f"{ON_LEAKS} SELECT content_key, count(*) AS occurrences, count(DISTINCT path) AS files FROM found GROUP BY content_key"
    )
    out["sanitized_text"] = f"SELECT page_id, {clean('html')} AS html, {clean('url')} AS url FROM pages"
    out["path_excluded"] = f"{PATHS} SELECT path, excluded_by IS NOT NULL AS excluded, excluded_by FROM ex"
    out["excluded_counts"] = (
        f"{PATHS} SELECT string_split(path, '/')[1] AS service, count(DISTINCT excluded_by) AS paths_excluded,"
        " count(excluded_by) AS files_excluded FROM ex GROUP BY 1"
    )
    late = r"regexp_matches(path, '^(?:.*/)?lib/d[0-9][^/]*/_f[^/]\.[^/]*$')"
    in_svc3 = "starts_with(path, 'svc3/')"
    env = r"regexp_matches(path, '\.env$')"
    config = "regexp_matches(path, '(^|/)config/')"
    last = f"CASE WHEN {late} THEN true WHEN starts_with(path, 'svc3/src/') THEN false WHEN {in_svc3} THEN true WHEN {config} AND {env} THEN false ELSE {env} END"
    out["ignore_negation"] = (
        f"WITH {LEAKS} SELECT DISTINCT path, {last} AS file_excluded, ({last}) OR {in_svc3} AS excluded FROM leaks"
    )
    out["repos_ignored"] = (
        f"WITH {LEAKS}, many AS (SELECT DISTINCT concat('r', cast(event_id % 3 AS string)) AS repo, path FROM leaks) SELECT repo, path,"
        f" CASE repo WHEN 'r0' THEN ({last}) OR {in_svc3} WHEN 'r1' THEN contains(path, '/docs/') OR"
        " (path LIKE '%.go' AND NOT starts_with(path, 'svc2/')) ELSE false END AS excluded FROM many"
    )
    out["file_statuses"] = f"WITH {LEAKS}, {FILES} SELECT CAST(root_ord AS INTEGER) AS root_ord, abs_path, path, status FROM files"
    out["file_coverage"] = f"WITH {LEAKS}, {FILES} SELECT {COUNTERS} FROM files"
    out["file_findings"] = f"{ON_OPEN_FILES}, {ctes('lines').strip()} SELECT {PLAIN} FROM found"
    open_files = OPEN_FILES.replace(f"{excluded_by('path')} AS excluded_by", "NULL AS excluded_by")
    out["lines_exploded"] = (
        f"WITH {LEAKS}, {open_files}, texts AS (SELECT path, body AS text FROM files WHERE status = 'scanned'), {LINES}"
        " SELECT path, line_no, md5(line) AS line_md5 FROM lines"
    )
    out["document_lines"] = f"WITH {DOC_TEXTS}, {LINES} SELECT path, line_no, md5(line) AS line_md5 FROM lines"
    out["patch_lines"] = (
        f"WITH {LEAKS}, {ADDED} SELECT path, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line_md5,"
        " commit_sha, commit_author, commit_date FROM lines"
    )
    out["files_in_patches"] = f"WITH {LEAKS}, {ADDED} SELECT count(DISTINCT new_path) AS files_scanned FROM patches"
    out["history_findings"] = f"{ON_PATCHES} SELECT {COMMIT} FROM found"
    out["history_dedup"] = f"{ON_PATCHES}, {dedup(False)} SELECT {COMMIT}, inline_hits FROM dd"
    out["history_dedup_strict"] = f"{ON_PATCHES}, {dedup(True)} SELECT {COMMIT}, inline_hits FROM dd"
    out["stream_dedup"] = f"{ON_PATCHES}, {dedup(False)} SELECT {COMMIT} FROM dd"
    out["stream_dedup_expiring"] = out["stream_dedup"]
    out["staged_findings"] = (
        f"{ON_PATCHES}, {dedup(False, live_only=True, commit=False)} SELECT {PLAIN} FROM dd WHERE NOT hidden"
    )
    out["inline_suppressed"] = (
        f"{ON_LEAKS} SELECT rule_id, CASE WHEN hidden THEN 'inline-ignore' END AS suppression_reason,"
        " count(*) AS findings FROM found GROUP BY 1, 2"
    )
    out["baseline_marked"] = (
        f"{BASELINE} SELECT rule_id, {REASON} AS suppression_reason, count(*) AS findings FROM marked GROUP BY 1, 2"
    )
    out["baseline_new"] = f"{BASELINE} SELECT {COMMIT} FROM marked WHERE NOT known"
    out["stream_new_findings"] = out["baseline_new"]
    out["stream_growing_baseline"] = f"{BASELINE} SELECT {COMMIT} FROM marked WHERE event_id % 2 = 0 OR NOT known"
    out["baseline_roundtrip"] = f"{ON_LEAKS} SELECT {COMMIT} FROM found WHERE NOT hidden"
    many = (
        "many AS (SELECT concat('r', cast(event_id % 3 AS string)) AS repo, replace(path, 'docs', 'dö' || chr(9) || 'cs') AS path,"
        " line_no, line, commit_date, event_id FROM leaks)"
    )
    on_many = f"WITH {LEAKS}, {many}, {ctes('many').strip()}"
    out["history_many_repos"] = (
        f"{on_many} SELECT repo, path AS file, rule_id, first(secret) AS secret, fingerprint, min(commit_date) AS commit_date"
        " FROM found WHERE NOT hidden GROUP BY repo, path, rule_id, fingerprint"
    )
    out["stream_export"] = (
        f"{on_many} SELECT rule_id, path AS file, count(*) AS findings, count(DISTINCT event_id) AS commits FROM found GROUP BY rule_id, path"
    )
    on_whole = on_many.replace("replace(path, 'docs', 'dö' || chr(9) || 'cs') AS path", "path")
    out["history_huge_commit"] = (
        f"{on_whole} SELECT repo, path AS file, CAST(min(line_no) AS INTEGER) AS line, rule_id, first(secret) AS secret, fingerprint,"
        " repeat('c', 40) AS commit_sha, 'First' AS commit_author, '2024-05-05T05:05:05Z' AS commit_date"
        " FROM found WHERE NOT hidden GROUP BY repo, path, rule_id, fingerprint"
    )
    out["staged_export"] = (
        f"{on_whole} SELECT path AS file, count(DISTINCT (repo, fingerprint)) AS n FROM found WHERE NOT hidden GROUP BY path"
        " UNION ALL SELECT NULL, count(DISTINCT (repo, path)) FROM many"
    )
    out["repos_summary"] = (
        f"{on_many} SELECT (SELECT count(DISTINCT (repo, path)) FROM many) AS files_scanned,"
        " count(DISTINCT (repo, fingerprint)) AS finding_count, count(DISTINCT (repo, path)) AS active_files"
        " FROM found WHERE NOT hidden"
    )
    out["baseline_applied"] = (
        f"{BASELINE} SELECT source, {COMMIT} FROM marked, (VALUES ('batch'), ('stream')) v(source) WHERE NOT known"
    )
    out["baseline_any_layout"] = out["baseline_roundtrip"]
    repo = "concat('r', cast(event_id % 3 AS string))"
    out["baseline_many_repos"] = (
        f"{ON_LEAKS}, base AS (SELECT DISTINCT content_key FROM found WHERE event_id % 3 = 1 AND NOT hidden)"
        f" SELECT {repo} AS repo, {COMMIT} FROM found"
        " WHERE event_id % 3 <> 1 OR content_key NOT IN (SELECT content_key FROM base)"
    )
    out["baseline_known"] = f"{BASELINE} SELECT {COMMIT} FROM marked WHERE known"
    out["baseline_moved"] = (
        f"{BASELINE} SELECT {REASON} AS suppression_reason, count(*) AS findings,"
        " count(DISTINCT fingerprint) AS fingerprints FROM marked GROUP BY 1"
    )
    out["rules_merged"] = (
        f"WITH {LEAKS}, {ctes('leaks', merged_rules()).strip()}"
        f" SELECT {hit}, before || secret || after AS match, secret FROM found"
    )
    out["scan_summary"] = (
        f"{FILE_SCAN} SELECT counts.*, total AS finding_count, CAST(1234 AS BIGINT) AS duration_ms, active, active_files,"
        " CAST(0 AS BIGINT) AS verified_active, CAST(0 AS BIGINT) AS verified_inactive, CAST(0 AS BIGINT) AS verified_unknown,"
        " nullif(inline_ignore, 0) AS inline_ignore, nullif(baselined, 0) AS baseline FROM totals, counts"
    )
    doc_lines = f"WITH {DOC_TEXTS}, {LINES}, {ctes('lines').strip()}"
    no_sign = DOC_TEXTS.replace("FROM documents", "FROM documents WHERE NOT contains(text, '=')")
    verdict = "CAST(CASE WHEN active > 0 THEN 1 ELSE 0 END AS INTEGER) AS verdict, active"
    out["scan_verdict"] = (
        f"SELECT 'files' AS source, CAST(CASE WHEN active > 0 OR files_unreadable > 0 THEN 1 ELSE 0 END AS INTEGER) AS verdict,"
        f" active FROM ({FILE_SCAN} SELECT active, files_unreadable FROM totals, counts) UNION ALL"
        f" SELECT 'documents', {verdict} FROM ({doc_lines} SELECT count(*) AS active FROM found WHERE NOT hidden) UNION ALL"
        f" SELECT 'clean', {verdict} FROM ({doc_lines.replace(DOC_TEXTS, no_sign)} SELECT count(*) AS active FROM found"
        " WHERE NOT hidden)"
    )
    live = dedup(False, live_only=True)
    out["patch_summary"] = (
        f"{ON_PATCHES}, {live} SELECT (SELECT count(DISTINCT new_path) FROM patches) AS files_scanned,"
        " count(*) FILTER (NOT hidden) AS finding_count, count(DISTINCT CASE WHEN NOT hidden THEN path END) AS active_files,"
        " (SELECT count(*) FROM found WHERE hidden) AS inline_ignore,"
        " CAST(CASE WHEN count(*) FILTER (NOT hidden) > 0 THEN 1 ELSE 0 END AS INTEGER) AS verdict FROM dd"
    )
    escaped = r"""'"' || replace(replace(replace(V, '\', '\\'), '"', '\"'), chr(9), '\t') || '"'"""

    def js(value: str) -> str:
        return escaped.replace("V", value)

    out["report_json"] = f"""{FILE_SCAN}
SELECT 0 AS section, '{{"findings":[' AS value
UNION ALL
SELECT 1, CASE WHEN row_number() OVER (ORDER BY path, line_no, col, rule_id, fingerprint) > 1 THEN ',' ELSE '' END || '{{"rule_id":' || {js('rule_id')} || ',"file":' || {js('path')} || ',"line":' || line_no || ',"column":' || col
  || ',"match":' || {js('(before || secret || after)')} || ',"secret":' || {js('secret')}
  || ',"fingerprint":' || {js('fingerprint')} || CASE WHEN heuristic THEN ',"is_heuristic":true' ELSE '' END
  || CASE WHEN reason IS NOT NULL THEN ',"suppressed":true,"suppression_reason":"' || reason || '"' ELSE '' END || '}}'
FROM result
UNION ALL
SELECT 2, '],"summary":{{"files_scanned":' || files_scanned || ',"finding_count":' || total || ',"duration_ms":1234'
  || CASE WHEN paths_excluded > 0 THEN ',"paths_excluded":' || paths_excluded ELSE '' END
  || CASE WHEN inline_ignore + baselined > 0 THEN ',"suppressed":{{' || concat_ws(',',
       CASE WHEN inline_ignore > 0 THEN '"inline-ignore":' || inline_ignore END,
       CASE WHEN baselined > 0 THEN '"baseline":' || baselined END) || '}}' ELSE '' END
  || CASE WHEN files_unreadable > 0 THEN ',"files_unreadable":' || files_unreadable ELSE '' END
  || CASE WHEN files_oversized > 0 THEN ',"files_oversized":' || files_oversized ELSE '' END
  || CASE WHEN files_binary > 0 THEN ',"files_binary":' || files_binary ELSE '' END || '}}}}'
FROM totals, counts"""
    advice = f"'    ↳ suppress: add `// scan:ignore` on this line · fingerprint: ' || {clean('fingerprint')}"
    name = "rule_id || CASE WHEN heuristic THEN ' ?' ELSE '' END"
    out["report_lines"] = f"""{FILE_SCAN}
SELECT 0 AS section, 0 AS part, {PLACE} || '  ' || {name} || '  ' || {clean('secret')} AS value FROM result WHERE reason IS NULL
UNION ALL SELECT 0, 2, {advice} FROM result WHERE reason IS NULL
UNION ALL SELECT 1, 0, '' FROM totals WHERE total > active
UNION ALL SELECT 1, 1, 'Suppressed (informational):' FROM totals WHERE total > active
UNION ALL SELECT 2, 0, '  ○ ' || {PLACE} || '  [' || rule_id || '] (' || reason || ')  ' || {clean('secret')} FROM result WHERE reason IS NOT NULL
UNION ALL {CLOSING.replace('DURATION', "'1.2s'")}
UNION ALL SELECT 3, 1, '  (skipped: ' || concat_ws(', ', CASE WHEN files_oversized > 0 THEN files_oversized || ' over --max-file-size' END,
  CASE WHEN files_binary > 0 THEN files_binary || ' binary' END) || ')' FROM counts WHERE files_oversized + files_binary > 0
UNION ALL SELECT 3, 2, format('⚠ {{}} file(s) could not be scanned — see warnings above; this scan is NOT complete', files_unreadable)
  FROM counts WHERE files_unreadable > 0
UNION ALL SELECT 3, 3, format('  ({{}} inline-ignore)', inline_ignore) FROM totals WHERE inline_ignore > 0
UNION ALL SELECT 3, 5, format('  ({{}} baseline)', baselined) FROM totals WHERE baselined > 0"""
    out["history_report"] = f"""{ON_PATCHES}, {live},
counts AS (SELECT count(DISTINCT new_path) AS files_scanned FROM patches),
totals AS (SELECT count(*) AS active, count(DISTINCT path) AS active_files FROM dd WHERE NOT hidden)
SELECT 0 AS section, 0 AS part, {PLACE} || ' @ ' || left(commit_sha, 7) || '  ' || {name} || '  ' || {clean('secret')} AS value
FROM dd WHERE NOT hidden
UNION ALL SELECT 0, 1, '    ↳ commit ' || commit_sha || ' by ' || commit_author || ' on ' || commit_date FROM dd WHERE NOT hidden
UNION ALL SELECT 0, 2, {advice} FROM dd WHERE NOT hidden
UNION ALL {CLOSING.replace('DURATION', "'0ms'")}
UNION ALL SELECT 3, 3, format('  ({{}} inline-ignore)', count(*)) FROM found WHERE hidden HAVING count(*) > 0"""
    out["probe_set"] = f"{PROBES} SELECT provider, h AS secret_sha256 FROM probes"
    out["github_status"] = f"{RESPONSES} SELECT h AS secret_sha256, status FROM ghs"
    out["aws_status"] = f"{RESPONSES} SELECT h AS secret_sha256, status FROM awss"
    out["verification_labels"] = (
        f'{RESPONSES} SELECT fingerprint, CAST(line_no AS INTEGER) AS line, col AS "column", commit_sha,'
        " CASE WHEN hidden THEN true END AS suppressed,"
        " CASE WHEN live AND provider IS NOT NULL THEN coalesce(answer, 'unknown') END AS status,"
        " CASE WHEN live THEN provider END AS provider FROM checked"
    )
    out["verification_tally"] = f"""{RESPONSES} SELECT count(*) FILTER (NOT hidden) AS active,
  count(*) FILTER (NOT hidden AND provider IS NOT NULL AND answer = 'active') AS verified_active,
  count(*) FILTER (NOT hidden AND provider IS NOT NULL AND answer = 'inactive') AS verified_inactive,
  count(*) FILTER (NOT hidden AND provider IS NOT NULL AND coalesce(answer, 'unknown') = 'unknown') AS verified_unknown
FROM checked"""
    out["aws_pairing"] = f"WITH {KEY_FILES}, {PAIRS} SELECT path, token FROM pairs"
    out["aws_key_pairs"] = f"""WITH {KEY_FILES}, {PAIRS}, {LINES.strip()}, {ctes('lines', default.only('aws-access-token')).strip()}
SELECT sha256(value) AS secret_sha256, first(path ORDER BY path) AS path, first(token ORDER BY path) AS token
FROM (SELECT DISTINCT f.value, path, token FROM found f JOIN pairs USING (path) WHERE NOT hidden) GROUP BY value"""
    tree = FILES.replace(
        "SELECT root_ord, abs_path, path, first_id, size, body, error FROM rows\n  UNION ALL\n"
        "  SELECT 2, abs_path, substr(path, length(string_split(path, '/')[1]) + 2), first_id, size, body, error\n"
        "  FROM rows WHERE first_id % 13 IN (5, 8)",
        "SELECT 0 AS root_ord, path AS abs_path, path, first_id, strlen(body) AS size, body, error FROM rows"
        " WHERE error IS NULL\n  UNION ALL\n"
        "  SELECT 1, path, substr(path, 6), first_id, strlen(body), body, error FROM rows"
        " WHERE error IS NULL AND starts_with(path, 'svc1/')",
    )
    on_tree = f"WITH {LEAKS}, {tree}, texts AS (SELECT path, body AS text FROM files WHERE status = 'scanned'), {LINES}"
    out["tree_findings"] = f"{on_tree}, {ctes('lines').strip()} SELECT {PLAIN} FROM found"
    out["tree_coverage"] = f"WITH {LEAKS}, {tree} SELECT {COUNTERS} FROM files"
    out["tree_manifest"] = f"""WITH {LEAKS}, {FILES},
seen AS (SELECT path, strlen(body) AS size, regexp_matches(path, '/(?:vendor|node_modules|build)/') AS pruned FROM rows WHERE error IS NULL)
SELECT path, false AS folder, CAST(size AS BIGINT) AS size FROM seen WHERE NOT pruned
UNION ALL
SELECT DISTINCT regexp_extract(path, '^.*?/(?:vendor|node_modules|build)'), true, CAST(-1 AS BIGINT) FROM seen WHERE pruned"""
    out["tree_unread"] = (
        f"WITH {LEAKS}, {FILES} SELECT path, 'unreadable' AS status, 'No such file or directory' AS error FROM rows"
        f" WHERE error IS NULL AND first_id % 13 IN (8, 9) AND {excluded_by('path')} IS NULL"
    )
    big = (
        "texts AS (SELECT concat('big/p', cast(cast(floor(event_id / 1000) AS bigint) AS string), '.txt') AS path,"
        " string_agg(line, chr(10) ORDER BY event_id) AS text FROM leaks GROUP BY 1)"
    )
    out["tree_large_files"] = (
        f"WITH {LEAKS}, {big}, {LINES}, {ctes('lines').strip()} SELECT {PLAIN} FROM found WHERE NOT hidden"
    )
    kept = f"SELECT path, body AS text FROM rows WHERE error IS NULL AND NOT (({last}) OR {in_svc3})"
    out["tree_ignored"] = (
        f"WITH {LEAKS}, rows AS ({DUCKDB_FILES}), texts AS ({kept}), {LINES}, {ctes('lines').strip()}"
        f" SELECT {PLAIN} FROM found WHERE NOT hidden"
    )
    sets = {"built-in": default, "project": rules_from_text(OWN_RULES), "explicit": merged_rules()}
    out["project_rules"] = " UNION ALL ".join(
        f"SELECT * FROM (WITH {LEAKS}, {ctes('leaks', rules).strip()}"
        f" SELECT {q(name)} AS source, rule_id, count(*) AS findings FROM found GROUP BY rule_id)"
        for name, rules in sets.items()
    )
    out["commit_times"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS commit_date FROM events"
    return {name: step_by_step(sql) for name, sql in out.items()}


def step_by_step(sql: str) -> str:
    """Every named step computed once: inlined steps make plans that take minutes below a LIMIT."""
    return re.sub(r"\b(\w+) AS \((?=\s*(?:SELECT|WITH)\b)", r"\1 AS MATERIALIZED (", sql)


ORACLES = _oracles()
