"""The registered queries in SQL for an engine on RE2, written apart from the plans: joins and windows over all
pairs of message and pattern in place of compiled branches."""

from __future__ import annotations

import json

from sievemill.functions import heuristic, lexicon, normalize
from sievemill.functions.regexes import positional
from sievemill.operators import match
from sievemill.operators.cluster import EXAMPLES, PRIORITIES, SPANS
from sievemill.operators.health import WEIGHTS
from sievemill.plans import messages as M
from sievemill.sources import catalog as catalogs

SPACES = r"[\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PARTS = {
    "cust": "lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')",
    "amount": "format('{:,.2f}', o_totalprice)",
    "day": "strftime(o_orderdate, '%Y-%m-%d')",
    "minute": "strftime(o_orderdate, '%Y-%m-%d %H:%M')",
    "hour": "strftime(o_orderdate, '%H:%M')",
    "balance": "printf('%.2f', abs(c_acctbal))",
    "ref": "'FT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || 'K'",
    "six": "lpad(CAST(o_orderkey * 7 % 1000000 AS VARCHAR), 6, '0')",
    "two": "lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0')",
}


def _q(text: object) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def _body(template: str) -> str:
    out = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        out.append(_PARTS[piece] if i % 2 else _q(piece))
    return " || ".join(out)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}|{SPACES}$', '', 'g')"


def _case(values: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in values) + f" ELSE {other} END"


_banks, _patterns = (read(str(M.FIXTURES / f)) for read, f in zip((catalogs.read_banks, catalogs.read_patterns), catalogs.FILES))
_RAW = f"""raw AS (SELECT o_orderkey AS seq,
  {_case([(f"o_orderkey // {len(M.BODIES)} % {len(M.SENDERS)} = {i}", _q(s)) for i, s in enumerate(M.SENDERS)], "NULL")} AS address,
  CASE WHEN o_orderkey % 50 = 11 THEN {_q(M.BLANK)} ELSE {_case([(f"o_orderkey % {len(M.BODIES)} = {i}", _body(b)) for i, b in enumerate(M.BODIES)], "NULL")} END AS body,
  CAST(epoch_ms(o_orderdate) AS BIGINT) AS date_ms
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_MSGS = _RAW + ",\nm AS (SELECT * FROM raw WHERE trim(body) <> '')"
_NORM = f"regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]', '', 'g')"
_BANK = _case([(" OR ".join(f"contains({_NORM}, {_q(match._token(c))})" for c in b.codes), str(b.id)) for b in _banks], "NULL")
_SENT = f"s AS (SELECT *, {_trim('body')} AS clean, {_BANK} AS sender_bank FROM m)"


def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(replace({x}, ',', '')), '[^0-9.]$', ''), '[.]+$', '')"


def _parses(x: str) -> str:
    return f"(TRY_CAST({_clean(x)} AS DOUBLE) IS NOT NULL)"


def _hit(ord_: int, p: match.Pattern) -> str:
    plain, names = positional(p.regex)
    rx = _q("(?ims)" + plain)
    got = lambda n: f"nullif(regexp_extract(clean, {rx}, {names[n]}), '')" if n in names else "NULL"
    flag = lambda x: "true" if x else "false"
    amount = _parses(got("amount")) if "amount" in names else "false"
    kind = f"CASE WHEN contains(lower({got('type')}), 'debit') THEN 'DEBIT' WHEN contains(lower({got('type')}), 'credit') THEN 'CREDIT' ELSE {_q(p.type)} END"
    tries = []
    for search in match.PARTY_SEARCHES:
        v = f"nullif({_trim(f'regexp_extract(clean, {_q(search)}, 1)')}, '')"
        tries.append(f"CASE WHEN {' AND '.join(f'NOT contains(lower({v}), {_q(o)})' for o in match.OWN)} THEN {v} END")
    party = [f"coalesce({_trim(got(n))} <> '', false)" for n in (*match.PARTY_GROUPS, "creditor", "receiver") if n in names]
    party.append(f"(contains(upper({kind}), 'CREDIT') AND coalesce({', '.join(tries)}) IS NOT NULL)")
    fees = [_parses(got(next(n for n in ns if n in names))) for ns in match.FEE_GROUPS if any(n in names for n in ns)]
    real = f"({got('reference')} IS NOT NULL)"
    return f"""SELECT seq, {ord_} AS ord, {p.bank_id} AS bank_id, {_q(p.type)} AS tx_type, {_q(p.description)} AS pattern_desc,
    ({kind}) IN ('CREDIT', 'DEBIT') AS type_valid, {amount} AS amount_parsed, {flag('balance' in names)} AS balance_expected, {got('balance')} IS NOT NULL AS balance_captured,
    {_parses(got('balance')) if 'balance' in names else 'false'} AS balance_parsed, ({' OR '.join(party)}) AS counterparty, {real} AS ref_real,
    {f'NOT {real}' if p.ref_required is False else 'false'} AS ref_synth, {flag('account' in names)} AS account_expected, {got('account')} IS NOT NULL AS account_captured,
    {flag(p.has_fees is True)} AS fees_expected, ({' OR '.join(fees) or 'false'}) AS fees_captured, {flag(p.ref_required is True)} AS ref_needed, {flag(p.has_account is True)} AS account_needed
    FROM s WHERE (sender_bank IS NULL OR sender_bank NOT IN (SELECT bank_id FROM pats) OR sender_bank = {p.bank_id}) AND regexp_matches(clean, {rx})"""


_VALID = [(i, p) for i, p in enumerate(_patterns) if p.description != "Epsilon broken"]
def _pats(patterns: list[match.Pattern]) -> str:
    return "pats AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p.bank_id}, {_q(p.sender_id)}, {_q(p.regex)}, {_q(p.type)}, {_q(p.description)})" for i, p in enumerate(patterns)) + ") AS p(pattern_ord, bank_id, sender_id, regex, type, description))"


_PATS = _pats(_patterns)
_BANKS = "banks AS (SELECT * FROM (VALUES " + ", ".join(f"({b.id}, {_q(b.shown)})" for b in _banks) + ") AS b(id, shown))"
_GATE = "CASE WHEN NOT amount_parsed THEN 'amountMissing' WHEN balance_expected AND NOT balance_captured THEN 'balanceMissing' WHEN ref_needed AND NOT ref_real THEN 'refMissing' WHEN account_needed AND account_expected AND NOT account_captured THEN 'accountMissing' ELSE 'none' END"


def _parsed(messages: str, pats: str, patterns: list[tuple[int, match.Pattern]]) -> str:
    return ",\n".join(
    (
        messages,
        pats,
        _BANKS,
        _SENT,
        "h AS (" + "\nUNION ALL ".join(_hit(i, p) for i, p in patterns) + ")",
        f"g AS (SELECT *, {_GATE} AS reason FROM h)",
        "best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY seq ORDER BY reason <> 'none', ord) = 1)",
        "p AS (SELECT s.seq, s.body, s.clean, s.date_ms, best.seq IS NOT NULL AS matched, coalesce(best.bank_id, sender_bank) AS bank_id, shown AS bank_name, tx_type, pattern_desc, ord AS pattern_ord, reason, reason = 'none' AS accepted,"
        + ", ".join(match.FLAG_COLUMNS)
        + " FROM s LEFT JOIN best USING (seq) LEFT JOIN banks ON id = coalesce(best.bank_id, sender_bank))",
    )
)


_PARSED = _parsed(_MSGS, _PATS, _VALID)
_TEMPLATED = _PARSED + f",\nt AS (SELECT *, {normalize.sql('body', SPACES)} AS template FROM p)"
_PLAIN = _MSGS + f",\nt AS (SELECT *, {normalize.sql('body', SPACES)} AS template FROM m)"
_prio = lambda c, k: _case([(f"{c} >= {p[0]}", _q(p[k]) if k == 1 else str(p[k])) for p in PRIORITIES], "'Very Low'" if k == 1 else "1")
_ANCHORS = "len(regexp_extract_all(regexp_replace(template, '<[A-Z]+>', ' ', 'g'), '\\b[A-Za-z]{2,}\\b'))"
_STRONG = "(contains(template, '<ACCOUNT>') OR contains(template, '<AMOUNT>') OR contains(template, '<REFERENCE>'))"
_READY = f"CASE WHEN {_STRONG} AND {_ANCHORS} >= 6 THEN 'High' WHEN ({_STRONG} AND {_ANCHORS} >= 3) OR {_ANCHORS} >= 8 THEN 'Medium' ELSE 'Low' END"
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c in lexicon.lexicon()) + ") AS l(lemma, direction, form))"
_VERBS = """w AS (SELECT template, unnest(ws) AS form, generate_subscripts(ws, 1) AS pos FROM (SELECT template, regexp_extract_all(lower(template), '[a-z]+') AS ws FROM (SELECT DISTINCT template FROM t))),
v AS (SELECT template, lemma AS verb, direction FROM w JOIN lex USING (form) QUALIFY row_number() OVER (PARTITION BY template ORDER BY direction = 'neutral', pos) = 1)"""
_MODE = """votes AS (SELECT matched, template, bank_id, count(*) AS n, min(seq) AS first_seq, any_value(bank_name) AS bank_name FROM t WHERE bank_id IS NOT NULL GROUP BY ALL),
mode AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY matched, template ORDER BY n DESC, first_seq) = 1)"""
_EX = f"ex AS (SELECT matched, template, {_trim('body')} AS body, row_number() OVER (PARTITION BY matched, template ORDER BY seq, body) AS k FROM t QUALIFY k <= {EXAMPLES})"


def _clusters(templated: str) -> str:
    return ",\n".join(
    (
        templated,
        _LEX,
        _VERBS,
        _MODE,
        _EX,
        f"c0 AS (SELECT matched, template, count(*) AS occurrences, {_prio('count(*)', 1)} AS priority, {_prio('count(*)', 2)} AS priority_rank, {_READY} AS readiness FROM t GROUP BY ALL)",
        f"""c AS (SELECT c0.*, mode.bank_id, mode.bank_name, verb, direction,
  CASE WHEN matched THEN 'success' WHEN mode.bank_id IS NOT NULL THEN 'attributed' WHEN {heuristic.sql("(SELECT body FROM ex WHERE ex.matched = c0.matched AND ex.template = c0.template AND k = 1)")} THEN 'candidate' ELSE 'noise' END AS stream
  FROM c0 LEFT JOIN mode USING (matched, template) LEFT JOIN v USING (template))""",
    )
)


_CLUSTERS = _clusters(_TEMPLATED)
_LABEL = "CASE WHEN verb IS NULL THEN NULL WHEN direction = 'neutral' THEN upper(verb[1]) || verb[2:] || 's' ELSE upper(direction[1]) || direction[2:] || ' ' || verb || 's' END"
_TO_FAMILIES = f""",
k AS (SELECT *, coalesce(CAST(bank_id AS VARCHAR), '') || chr(1) || CASE WHEN verb IS NULL THEN 't:' || template ELSE 'v:' || verb || ':' || direction END AS family FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY stream, family ORDER BY occurrences DESC, template) AS place FROM k),
fx AS (SELECT stream, family, body, min(place * 1000 + ex.k) AS o FROM r JOIN ex USING (matched, template) GROUP BY ALL),
fe AS (SELECT stream, family, string_agg(body, ' ¶ ' ORDER BY o) AS examples FROM (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY stream, family ORDER BY o) <= 6) GROUP BY ALL),
f AS (SELECT stream, family, min_by(template, place) AS template, min_by(bank_id, place) AS bank_id, min_by(bank_name, place) FILTER (WHERE place = 1) AS bank_name, min_by(verb, place) FILTER (WHERE place = 1) AS verb, min_by(direction, place) FILTER (WHERE place = 1) AS direction,
  count(*) AS member_count, CAST(sum(occurrences) AS BIGINT) AS total, coalesce(string_agg(template, ' ¶ ' ORDER BY place) FILTER (WHERE place > 1), '') AS variants FROM r GROUP BY ALL)"""
_FAMILIES = _CLUSTERS + _TO_FAMILIES
_HCOUNTS = "count(*) AS members, count_if(accepted) AS accepted, " + ", ".join(f"count_if({c}) AS {c}" for c in match.FLAG_COLUMNS)
_RATES = ", ".join(f"round({c} / members, 4) AS {c}_rate" for c in ("accepted", *match.FLAG_COLUMNS))
_SCORE = f"CAST(round(round(accepted / members * ({WEIGHTS['type']} * type_valid / members + {WEIGHTS['balance']} * balance_parsed / members + {WEIGHTS['party']} * counterparty / members + {WEIGHTS['reference']} * ref_real / members + {WEIGHTS['account']} * (members - account_expected + account_captured) / members + {WEIGHTS['fees']} * (members - fees_expected + fees_captured) / members), 9)) AS INTEGER)"
_SUCCESS = _FAMILIES + f""",
own AS (SELECT template, family FROM r WHERE matched),
hc AS (SELECT family, {_HCOUNTS} FROM t JOIN own USING (template) WHERE t.matched GROUP BY ALL),
pd AS (SELECT family, pattern_desc FROM (SELECT family, pattern_desc, count(*) AS n, min(seq) AS first_seq FROM t JOIN own USING (template) WHERE t.matched GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, first_seq) = 1),
su AS (SELECT f.template, f.bank_id, f.bank_name, f.verb, f.direction, hc.*, pattern_desc, {_SCORE} AS health_score, accepted = members AS app_accepted FROM f JOIN hc USING (family) LEFT JOIN pd USING (family) WHERE stream = 'success')"""
_DOCS = "d AS (SELECT doc_id AS seq, source AS address, coalesce(text, '') AS body FROM documents)"
_UNION = _MSGS + f",\n{_DOCS},\nu AS (SELECT 'documents' AS source, 0 AS o, seq, address, body FROM d UNION ALL SELECT 'messages', 1, seq, address, body FROM m UNION ALL SELECT 'again', 2, seq, address, body FROM m)"


_VERB = _case([(f"l_suppkey % {len(M.STARTS)} = {i}", _q(v)) for i, (v, _) in enumerate(M.STARTS)], "NULL")
_VARIED = f"""m AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, {_case([(f"l_partkey % {len(M.SENDERS)} = {i}", _q(v)) for i, v in enumerate(M.SENDERS)], "NULL")} AS address,
  {_VERB} || ' ETB ' || format('{{:,.2f}}', l_extendedprice) || ' for ' || p_name || ' ' || {_case([(f"l_linestatus = {_q(k)}", _q(v)) for k, v in M.ENDS.items()], "NULL")} || ', ref FT' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || 'K' AS body,
  CAST(epoch_ms(l_shipdate) AS BIGINT) AS date_ms FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_LARGE = _parsed(_VARIED, _pats(M.large_patterns()), list(enumerate(M.large_patterns())))
_LARGE_CLUSTERS = _clusters(_LARGE + f",\nt AS (SELECT *, {normalize.sql('body', SPACES)} AS template FROM p)")
#: What shapes.field_shapes says of the values in `capped`, one character after the other.
_SHAPES = r"""vals AS (SELECT template, field, left(value, 512) AS v FROM capped), uniq AS (SELECT DISTINCT * FROM vals),
st AS (SELECT template, field, count(*) AS samples, count(DISTINCT v) AS n_distinct, min(length(v)) AS low, max(length(v)) AS high, bool_or(regexp_matches(v, '[0-9]')) AS digit, bool_or(regexp_matches(v, '[A-Za-z]')) AS letter FROM vals GROUP BY ALL),
tk AS (SELECT template, field, v, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM (SELECT *, regexp_extract_all(v, '[0-9]+|[A-Za-z]+|[^0-9A-Za-z]') AS ts FROM uniq)),
odd AS (SELECT template, field, string_agg(regexp_replace(t, '([\\^\]\-])', '\\\1'), '' ORDER BY t) AS literals FROM (SELECT DISTINCT template, field, t FROM tk WHERE NOT regexp_matches(t, '^[0-9A-Za-z]')) GROUP BY ALL),
ns AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9A-Za-z]') OR t IS DISTINCT FROM lag(t) OVER (PARTITION BY template, field, v ORDER BY p) THEN 1 ELSE 0 END AS new FROM tk),
rn AS (SELECT *, sum(new) OVER (PARTITION BY template, field, v ORDER BY p) AS r FROM ns),
rs AS (SELECT template, field, v, r, sum(length(t)) AS n, min(t) AS t, CASE WHEN regexp_matches(min(t), '^[0-9]') THEN 'digit' WHEN regexp_matches(min(t), '^[A-Za-z]') THEN 'letter' ELSE 'L' || min(t)[1] END AS kind FROM rn GROUP BY ALL),
sg AS (SELECT template, field, v, string_agg(kind, '|' ORDER BY r) AS sig FROM rs GROUP BY ALL),
tn AS (SELECT template, field, sig, r, min(n) AS lo, max(n) AS hi, min(t) AS t FROM rs JOIN sg USING (template, field, v) GROUP BY ALL),
al AS (SELECT template, field, sig, string_agg(CASE WHEN regexp_matches(t, '^[0-9]') THEN '\d' WHEN regexp_matches(t, '^[A-Za-z]') THEN '[A-Za-z]' ELSE regexp_replace(t[1], '([\\^$.|?*+()\[\]{}/])', '\\\1') END || CASE WHEN lo = 1 AND hi = 1 THEN '' WHEN lo = hi THEN '{' || lo || '}' ELSE '{' || lo || ',' || hi || '}' END, '' ORDER BY r) AS alt FROM tn GROUP BY ALL),
an AS (SELECT template, field, count(*) AS n_structures, string_agg(alt, '|' ORDER BY alt) AS alts FROM al GROUP BY ALL),
sh AS (SELECT *, '[' || CASE WHEN digit THEN '\d' ELSE '' END || CASE WHEN letter THEN 'A-Za-z' ELSE '' END || coalesce(literals, '') || ']' AS chars FROM st LEFT JOIN odd USING (template, field) LEFT JOIN an USING (template, field))
SELECT template, field, CASE WHEN n_distinct < 3 THEN chars || '+' WHEN n_structures > 4 THEN chars || CASE WHEN low = 1 AND high = 1 THEN '' WHEN low = high THEN '{' || low || '}' ELSE '{' || low || ',' || high || '}' END WHEN n_structures = 1 THEN alts ELSE '(?:' || alts || ')' END AS regex, samples FROM sh"""


def _spans() -> str:
    """Values of each rule: what the rule finds in the text that the rules before it made."""
    n = len(normalize.RULES)
    out = f"sp0 AS (SELECT *, substr(body, 1, {normalize.MOST_CHARS}) AS t0 FROM {{rows}})"
    for i, r in enumerate(normalize.RULES):
        rx = r.re2.replace("'", "''").replace("{", "{{").replace("}", "}}")
        found = r.value.replace("'", "''").replace("{", "{{").replace("}", "}}")
        out += f",\nsp{i + 1} AS (SELECT *, regexp_extract_all(t{i}, '{found}', {r.value_group}) AS v{i}, regexp_replace(t{i}, '{rx}', '{r.re2_put}', 'g') AS t{i + 1} FROM sp{i})"
    rows = " UNION ALL ".join(f"SELECT seq, t{n}, {i} AS rule, '{r.field}' AS field, v{i} AS vals FROM sp{n}" for i, r in enumerate(normalize.RULES))
    return out + f",\nspans AS (SELECT seq, trim(regexp_replace(t{n}, '{SPACES.replace('{', '{{').replace('}', '}}')}', ' ', 'g')) AS template, rule, field, unnest(vals) AS value, generate_subscripts(vals, 1) AS pos FROM ({rows}))"


_SPANS = _spans()


def sql() -> dict[str, str]:
    counted = lambda table, *keys: f"SELECT {', '.join(keys)}, count(*) AS messages FROM {table} GROUP BY ALL"
    cap = f"capped AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY template, field ORDER BY seq, rule, pos) <= {SPANS})"
    merged = "SELECT address, body, count(*) AS n FROM u GROUP BY ALL"
    out = {
        "normalize_messages": f"WITH {_PLAIN} SELECT seq, template FROM t",
        "normalize_documents": f"WITH {_DOCS}, t AS (SELECT seq, {normalize.sql('body', SPACES)} AS template FROM d) SELECT seq, md5(template) AS template_md5, length(template) AS n_chars FROM t",
        "template_clusters": f"WITH {_PLAIN} SELECT template, count(*) AS occurrences, {_prio('count(*)', 1)} AS priority, {_prio('count(*)', 2)} AS priority_rank, {_READY} AS readiness FROM t GROUP BY template",
        "cluster_examples": f"WITH {_PLAIN}, e AS (SELECT template, {_trim('body')} AS body, row_number() OVER (PARTITION BY template ORDER BY seq, body) AS k FROM t QUALIFY k <= {EXAMPLES}) SELECT template, string_agg(body, ' ¶ ' ORDER BY k) AS examples FROM e GROUP BY template",
        "cluster_mode_bank": f"WITH {_TEMPLATED}, {_MODE} SELECT matched, template, bank_id, bank_name FROM mode",
        "span_counts": f"WITH {_MSGS}, {_SPANS.format(rows='m')} SELECT rule, field, count(*) AS spans FROM spans GROUP BY ALL",
        "capped_spans": f"WITH {_MSGS}, {_SPANS.format(rows='m')}, {cap} SELECT template, field, count(*) AS spans FROM capped GROUP BY ALL",
        "truncation_flags": f"WITH {_DOCS} SELECT seq, length(body) > {normalize.MOST_CHARS} AS truncated FROM d",
        "record_mapping": "SELECT conv_id * 1000 + turn AS seq, role AS address, coalesce(text, '') AS body, CASE WHEN turn % 3 = 1 THEN NULL ELSE conv_id END AS date_ms, false AS malformed, " + f"{_trim('coalesce(text, NULL, ' + _q('') + ')')} = '' AS \"empty\" FROM conversations",
        "empty_body_filter": f"WITH {_RAW} SELECT count(*) AS total, count_if({_trim('body')} = '') AS empty_bodies FROM raw",
        "sender_filter": f"WITH {_MSGS} SELECT address, count(*) AS messages FROM m WHERE lower(address) IN ('alpha', 'beta') GROUP BY ALL",
        "content_rows": f"WITH {_MSGS} SELECT address, count(*) AS messages, CAST(sum(date_ms) AS BIGINT) AS date_sum, CAST(sum(length({_trim('body')})) AS BIGINT) AS body_chars FROM m GROUP BY ALL",
        "sender_resolution": f"WITH {_MSGS}, {_SENT} " + counted("s", "address", "sender_bank AS bank_id"),
        "candidate_scope": f"WITH {_MSGS}, {_PATS}, {_SENT}, n AS (SELECT bank_id, count(*) AS k FROM pats GROUP BY ALL) SELECT seq, coalesce(k, (SELECT count(*) FROM pats)) AS candidates FROM s LEFT JOIN n ON bank_id = sender_bank",
        "pattern_match": f"WITH {_PARSED} SELECT seq, matched, bank_id, bank_name, tx_type, pattern_desc, pattern_ord FROM p",
        "field_extraction": f"WITH {_PARSED} SELECT seq, {', '.join(match.FLAG_COLUMNS)} FROM p WHERE matched",
        "accept_gate": f"WITH {_PARSED} " + counted("p", "pattern_ord", "reason").replace(" GROUP", " WHERE matched GROUP"),
        "transaction_heuristic": f"WITH {_MSGS}, {_DOCS} SELECT 'message' AS kind, seq, {heuristic.sql('body')} AS transactional FROM m UNION ALL SELECT 'document', seq, {heuristic.sql('body')} FROM d",
        "coverage_overall": f"WITH {_PARSED} SELECT count(*) AS total, count_if(matched) AS matched, count_if(coalesce(accepted, false)) AS app_accepted, count_if(NOT matched AND bank_id IS NULL) AS unattributed, count_if(body IS NULL) AS parse_errors, count_if(matched) / count(*) * 100 AS coverage_pct FROM p",
        "coverage_by_bank": f"WITH {_PARSED} SELECT bank_id, any_value(bank_name) AS bank_name, count(*) AS total, count_if(matched) AS matched, count_if(NOT matched) AS unmatched, count_if(matched) / count(*) * 100 AS coverage_pct FROM p WHERE bank_id IS NOT NULL GROUP BY bank_id",
        "largest_missing": f"WITH {_CLUSTERS} SELECT bank_id, template, occurrences, priority FROM c WHERE NOT matched AND bank_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY priority_rank DESC, occurrences DESC, template) = 1",
        "dataset_stats_type": f"WITH {_PARSED} SELECT coalesce(tx_type, 'UNKNOWN') AS tx_type, count(*) AS messages FROM p WHERE matched GROUP BY 1",
        "dataset_stats_bank": f"WITH {_PARSED} SELECT coalesce(bank_name, 'Unknown') AS bank_name, count(*) AS messages FROM p GROUP BY 1",
        "candidate_vs_noise": f"WITH {_CLUSTERS} SELECT stream, template, occurrences, bank_id FROM c",
        "top_gaps": f"WITH {_CLUSTERS} SELECT template, occurrences, priority, stream FROM c WHERE NOT matched ORDER BY priority_rank DESC, occurrences DESC, template LIMIT 25",
        "verb_annotation": f"WITH {_PLAIN}, {_LEX}, {_VERBS} SELECT template, verb, direction FROM (SELECT DISTINCT template FROM t) LEFT JOIN v USING (template)",
        "families_verb": f"WITH {_FAMILIES} SELECT f.stream, template, bank_id, verb, direction, {_LABEL} AS label, member_count, total, {_prio('total', 1)} AS priority, member_count - 1 AS n_variants, variants, examples FROM f JOIN fe USING (stream, family)",
        "families_identity": f"WITH {_CLUSTERS} SELECT stream, template, bank_id, CAST(1 AS BIGINT) AS member_count, occurrences AS total, priority, readiness FROM c",
        "similar_template_pairs": f"WITH {_CLUSTERS}, x AS (SELECT DISTINCT bank_id, template FROM c), y AS (SELECT a.bank_id, a.template AS a, b.template AS b, 1 - levenshtein(a.template, b.template) / greatest(length(a.template), length(b.template)) AS z FROM x a JOIN x b ON a.bank_id IS NOT DISTINCT FROM b.bank_id AND a.template < b.template) SELECT bank_id, a, b, round(z, 6) AS similarity FROM y WHERE z >= 0.4",
        "families_levenshtein": _levenshtein(_CLUSTERS, 0.6),
        "health_rates": f"WITH {_TEMPLATED}, hc AS (SELECT template, {_HCOUNTS} FROM t WHERE matched GROUP BY ALL) SELECT template, members, {_RATES} FROM hc",
        "health_score": f"WITH {_SUCCESS} SELECT template, bank_id, members, pattern_desc, health_score, app_accepted FROM su",
        "reconciliation": f"WITH {_SUCCESS} SELECT CAST(round(sum(health_score * members) / sum(members)) AS INTEGER) AS mean_health_score, "
        + ", ".join(f"round(sum({c}) / sum(members) * 100, 2) AS {n}_share" for c, n in (("type_valid", "type_valid"), ("balance_captured", "balance_captured"), ("counterparty", "counterparty"), ("accepted", "app_accepted")))
        + ", count_if(app_accepted AND health_score < 50) AS low_health_families FROM su",
        "field_shape_quantifiers": f"WITH {_MSGS}, {_SPANS.format(rows='m')} , x AS (SELECT template, field, min(length(value)) AS lo, max(length(value)) AS hi FROM (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY template, field ORDER BY seq, rule, pos) <= {SPANS}) GROUP BY ALL) SELECT template, field, CASE WHEN lo = 1 AND hi = 1 THEN '' WHEN lo = hi THEN '{{' || lo || '}}' ELSE '{{' || lo || ',' || hi || '}}' END AS quantifier FROM x",
        "corpus_dedup": f"WITH {_UNION} SELECT source, seq, address FROM u QUALIFY row_number() OVER (PARTITION BY address, body ORDER BY o, seq) = 1",
        "corpus_counts": f"WITH {_UNION} SELECT CAST(sum(n) AS BIGINT) AS total_input, count(*) AS unique_count, CAST(sum(n) - count(*) AS BIGINT) AS duplicates_removed FROM ({merged})",
        "corpus_sources": f"WITH {_UNION} " + counted("u", "source"),
        "dataset_id": f"WITH {_UNION}, {_fingerprint('u', 'dataset_id', 'address', 'body')}",
        "baseline_signature": f"WITH {_PATS}, {_fingerprint('pats', 'signature', 'CAST(bank_id AS VARCHAR)', 'sender_id', 'regex', 'type', 'description')}",
        "baseline_diff": f"""WITH {_PATS}, nxt AS (SELECT bank_id, description, CASE WHEN pattern_ord = 5 THEN regex || ' [0-9]' ELSE regex END AS regex FROM pats WHERE pattern_ord <> 4 UNION ALL SELECT bank_id, 'Alpha new', regex FROM pats WHERE pattern_ord = 0),
j AS (SELECT coalesce(a.bank_id, b.bank_id) AS bank_id, coalesce(a.description, b.description) AS description, a.regex AS o, b.regex AS n FROM pats a FULL JOIN nxt b ON a.bank_id = b.bank_id AND a.description = b.description)
SELECT CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS kind, bank_id, description, coalesce(o, '') AS old, coalesce(n, '') AS new FROM j WHERE o IS DISTINCT FROM n""",
        "patterns_per_bank": f"WITH {_PATS} SELECT bank_id, count(*) AS patterns FROM pats GROUP BY ALL",
        "ledger_delta": "WITH o AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS idx, count(*) AS pattern_count FROM orders GROUP BY 1), l AS (SELECT idx, 's' || CAST(pattern_count // 20 AS VARCHAR) AS signature, pattern_count FROM o), k AS (SELECT * FROM l QUALIFY lag(signature) OVER (ORDER BY idx) IS DISTINCT FROM signature) SELECT *, pattern_count - lag(pattern_count) OVER (ORDER BY idx) AS delta FROM k",
        "lexicon_sync": f"WITH {_LEX} SELECT word FROM (VALUES {', '.join(f'({_q(w)})' for w in (M.FIXTURES / 'words.txt').read_text().split())}) AS x(word) WHERE word NOT IN (SELECT form FROM lex)",
        "catalog_table": f"WITH {_PATS} SELECT pattern_ord, bank_id, type, description, regex FROM pats",
        "application_patterns": f"WITH {_PATS} SELECT pattern_ord, bank_id, sender_id, type, description FROM pats",
        "rule_drift": "SELECT rule FROM (VALUES ('flags'), ('party')) AS r(rule)",
        "json_containers": "SELECT conv_id * 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role AS address, coalesce(text, '') AS body, conv_id * 1000 + turn AS date_ms, false AS malformed FROM conversations",
        "chat_ingest": f"WITH {_MSGS}, x AS (SELECT row_number() OVER (PARTITION BY seq % 100 ORDER BY seq) - 1 AS seq, body FROM m WHERE starts_with(body, 'Dear ')) SELECT seq, 'ALPHA' AS address, count(*) AS messages, CAST(sum(length(body)) AS BIGINT) AS body_chars FROM x GROUP BY ALL",
        "export_coverage_map": f"WITH {_PARSED} SELECT any_value(bank_name) AS bank_name, round(count_if(matched) / count(*) * 100, 2) AS percent FROM p WHERE bank_id IS NOT NULL GROUP BY bank_id",
        "export_units_degraded": f"WITH {_FAMILIES} SELECT NULL AS normalized_text, NULL AS verb, NULL AS direction, total AS count, bank_name AS bank, false AS matched, true AS degraded FROM f WHERE stream IN ('attributed', 'candidate')",
        "field_shapes": f"WITH {_MSGS}, {_SPANS.format(rows='m')}, {cap}, {_SHAPES}",
        "varied_pattern_match": f"WITH {_LARGE} SELECT pattern_ord, bank_id, tx_type, count(*) AS messages, count_if(coalesce(accepted, false)) AS accepted FROM p GROUP BY ALL",
        "varied_clusters": f"WITH {_LARGE_CLUSTERS} SELECT stream, template, bank_id, occurrences, priority, verb, direction FROM c",
        "varied_examples": f"WITH {_LARGE_CLUSTERS} SELECT matched, template, string_agg(body, ' ¶ ' ORDER BY k) AS examples FROM ex GROUP BY ALL",
        "varied_families_verb": f"WITH {_LARGE_CLUSTERS}{_TO_FAMILIES} SELECT stream, template, bank_id, verb, member_count, total, variants, examples FROM f JOIN fe USING (stream, family)",
        "varied_families_levenshtein": _levenshtein(_LARGE_CLUSTERS, 0.85),
        "varied_similar_pairs": f"WITH {_LARGE_CLUSTERS}, x AS (SELECT DISTINCT bank_id, template FROM c), y AS (SELECT a.bank_id, a.template AS a, b.template AS b, 1 - levenshtein(a.template, b.template) / greatest(length(a.template), length(b.template)) AS z FROM x a JOIN x b ON a.bank_id IS NOT DISTINCT FROM b.bank_id AND a.template < b.template) SELECT bank_id, a, b, round(z, 6) AS similarity FROM y WHERE z >= 0.92",
        "varied_largest_missing": f"WITH {_LARGE_CLUSTERS} SELECT bank_id, template, occurrences, priority FROM c WHERE NOT matched AND bank_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bank_id ORDER BY priority_rank DESC, occurrences DESC, template) = 1",
        "export_units_unmatched": f"WITH {_FAMILIES} SELECT template AS normalized_text, verb, direction, total AS count, bank_name AS bank, false AS matched, false AS degraded FROM f WHERE stream IN ('attributed', 'candidate')",
        "export_units_success": f"WITH {_SUCCESS} SELECT template AS normalized_text, verb, direction, members AS count, bank_name AS bank, true AS matched, pattern_desc, app_accepted, health_score, {_RATES}, false AS degraded FROM su",
        "export_metadata": f"WITH {_PARSED} SELECT count(*) AS total, count_if(matched) AS regex_matched, count_if(coalesce(accepted, false)) AS app_accepted, count_if(matched) - count_if(coalesce(accepted, false)) AS app_rejected, count_if(NOT matched) AS unparsed, round(count_if(matched) / count(*) * 100, 2) AS parsed_percent, count_if(body IS NULL) AS parse_errors FROM p",
        "quality_rollup": f"WITH {_FAMILIES} SELECT (SELECT count(*) FROM m) AS messages_loaded, (SELECT count_if(length(body) > {normalize.MOST_CHARS}) FROM m) AS normalization_truncated, CAST(0 AS BIGINT) AS dataset_malformed, (SELECT count_if({_trim('body')} = '') FROM raw) AS dataset_empty_bodies, "
        + f"(SELECT count_if(body IS NULL) FROM m) AS parse_errors, CAST(0 AS BIGINT) AS clustering_skipped, CAST(0 AS BIGINT) AS normalization_degraded, (SELECT count(*) FROM f WHERE stream <> 'noise') AS units_exported, CAST(0 AS BIGINT) AS units_redacted, CAST(0 AS BIGINT) AS unit_errors, CAST(0 AS BIGINT) AS field_shape_fallbacks, CAST({len(_patterns) - len(_VALID)} AS BIGINT) AS invalid_patterns, true AS clean",
        "quality_rollup_documents": f"WITH d AS (SELECT CASE WHEN doc_id % 97 <> 5 THEN text END AS body FROM documents) SELECT count(*) AS messages_loaded, CAST(0 AS BIGINT) AS dataset_malformed, count_if({_trim("coalesce(body, '')")} = '') AS dataset_empty_bodies, count_if(body IS NULL) AS parse_errors, count(*) AS normalization_degraded, count_if(length(body) > {normalize.MOST_CHARS}) AS normalization_truncated, count_if(body IS NULL) AS clustering_skipped, "
        + ", ".join(f"CAST(0 AS BIGINT) AS {z}" for z in ("units_exported", "units_redacted", "unit_errors", "field_shape_fallbacks", "invalid_patterns"))
        + ", false AS clean FROM d",
    }
    return out


def _levenshtein(clusters: str, threshold: float) -> str:
    """Greedy families, one template after the other: each row carries the seeds so far."""
    near = f"levenshtein(x, r.template) <= floor(round({1 - threshold:.6f} * greatest(length(x), length(r.template)), 6))"
    return f"""WITH RECURSIVE {clusters},
rk AS (SELECT *, row_number() OVER (PARTITION BY stream, bank_id ORDER BY occurrences DESC, template) AS i FROM c),
lev AS (SELECT stream, bank_id, i, template, occurrences, [template] AS seeds, template AS seed FROM rk WHERE i = 1
  UNION ALL
  SELECT r.stream, r.bank_id, r.i, r.template, r.occurrences, CASE WHEN hit IS NULL THEN list_append(lev.seeds, r.template) ELSE lev.seeds END, coalesce(hit, r.template)
  FROM lev JOIN rk AS r ON r.stream = lev.stream AND r.bank_id IS NOT DISTINCT FROM lev.bank_id AND r.i = lev.i + 1, LATERAL (SELECT list_filter(lev.seeds, lambda x: {near})[1] AS hit))
SELECT stream, seed AS template, bank_id, count(*) AS member_count, CAST(sum(occurrences) AS BIGINT) AS total FROM lev GROUP BY ALL"""


def _fingerprint(table: str, name: str, *columns: str) -> str:
    key = "sha256(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns) + ")"
    return f"hh AS (SELECT DISTINCT {key} AS h FROM {table}), rr AS (SELECT h[1:2] AS r, sha256(string_agg(h, '' ORDER BY h)) AS h FROM hh GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY r))[1:16] AS {name} FROM rr"


if __name__ == "__main__":
    print(json.dumps(sql(), indent=1, ensure_ascii=False))
