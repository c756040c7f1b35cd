"""DuckDB SQL for the message queries.

Patterns and word lists are written out here by themselves, from what the operators should do, and share nothing with the
implementation: a wrong pattern there can't agree with itself here.
"""

from __future__ import annotations

_T = r"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
  CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END AS id, role, text AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM conversations))"""
_S = (
    _T
    + r""",
s AS (SELECT conv_id, pos * 4 + k AS pos, id || '-' || CAST(k AS VARCHAR) AS id, role,
  CASE k WHEN 1 THEN 'Actually, we should use the ' || role || '_store api, not the old one. ' || content
         WHEN 2 THEN content || chr(10) || 'Reviewed by fetchData on line ' || CAST(pos AS VARCHAR) ELSE content END AS content
  FROM t, range(4) r(k)),
c AS (SELECT *, coalesce(content, '') AS x, count(*) OVER (PARTITION BY conv_id) AS n FROM s)"""
)
_FINE = r"length(x) >= {0} AND NOT starts_with(x, '[summary:') AND NOT starts_with(x, '[summary#') AND NOT starts_with(x, '[truncated')"
_COPIES = r"""e AS (SELECT *, greatest(0, n - 4) AS start FROM c WHERE {fine} AND role IS DISTINCT FROM 'system'),
k AS (SELECT *, coalesce(min(CASE WHEN pos >= start AND start > 0 THEN pos END) OVER (PARTITION BY conv_id, x), max(pos) OVER (PARTITION BY conv_id, x)) AS duplicate_of FROM e),
copies AS (SELECT k.conv_id, k.pos, k.duplicate_of, c.id AS duplicate_of_id, length(k.x) AS content_length FROM k JOIN c ON c.conv_id = k.conv_id AND c.pos = k.duplicate_of WHERE k.pos <> k.duplicate_of)""".format(
    fine=_FINE.format(200)
)
_LINED = r"""m AS (SELECT e.conv_id, e.pos, e.start, length(e.x) AS size, [y FOR y IN [lower(trim(z, ' ')) FOR z IN string_split(e.x, chr(10))] IF y <> ''] AS l
  FROM e ANTI JOIN copies ON copies.conv_id = e.conv_id AND copies.pos = e.pos),
f AS (SELECT * FROM m WHERE len(l) >= 2), h AS (SELECT conv_id, pos, unnest(l[1:5]) AS line FROM f),
q AS (SELECT x.conv_id, x.pos AS a, y.pos AS b FROM h x JOIN h y ON x.conv_id = y.conv_id AND x.line = y.line AND x.pos < y.pos GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT conv_id, pos, line, count(*) AS n FROM (SELECT conv_id, pos, unnest(l) AS line FROM f) GROUP BY ALL),
i AS (SELECT q.conv_id, q.a, q.b, sum(least(p.n, r.n)) AS common FROM q JOIN w p ON p.conv_id = q.conv_id AND p.pos = q.a JOIN w r ON r.conv_id = q.conv_id AND r.pos = q.b AND r.line = p.line GROUP BY ALL),
pairs AS (SELECT i.conv_id, i.a, i.b, common::DOUBLE / (len(x.l) + len(y.l) - common) AS s FROM i JOIN f x ON x.conv_id = i.conv_id AND x.pos = i.a JOIN f y ON y.conv_id = i.conv_id AND y.pos = i.b
  WHERE common::DOUBLE / (len(x.l) + len(y.l) - common) >= 0.85 AND least(x.size, y.size) >= greatest(x.size, y.size) * 0.7)"""

# -- classification


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(pattern: str) -> str:
    return f"regexp_matches(x, {_q(pattern)})"


def _all(pattern: str, of: str = "x") -> str:
    return f"regexp_extract_all({of}, {_q(pattern)})"


def _set(pattern: str) -> str:
    return rf"list_distinct([regexp_replace(lower(y), '\s+', ' ', 'g') for y in {_all(pattern)}])"


def _list(words: str) -> str:
    return "[" + ", ".join(_q(w) for w in words.split(",")) + "]"


_FIRM = "primary key,foreign key,group by,order by,not null,on conflict,with recursive,left join,right join,inner join,full join,cross join,natural join,truncate,cascade,constraint,returning,upsert,varchar,integer,boolean"
_LOOSE = "distinct,having,where,values,union,offset,join,merge,grant,revoke,trigger,procedure,cursor,declare"
_OTHER = "select,insert,update,delete,from,into,set,limit,create,alter,drop,fetch,schema,view"
_SQL = r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in sorted(f"{_FIRM},{_LOOSE},{_OTHER}".split(","), key=len, reverse=True)) + r")\b"
_HINT = r"(?i)\b(?:hence|thus|therefore|accordingly|consequently|as a result|since we know|given that|assuming that|because of this|this means that|which means|which shows|which implies)\b"
_STEPS = r"(?i)\b(?:firstly|first|secondly|second|thirdly|third|in summary|in conclusion|to summarize|let me think|let me reason|let me analyze|let's consider|let's break this down)\b"


def _key() -> str:
    """Known keys, else the first loose token that has a letter past f before its mark, a digit and a letter after it, and isn't hyphenated words."""
    known = r"(?:^|[^0-9A-Za-z-])sk-[0-9A-Za-z_-]{20}|\bAKIA[0-9A-Z]{16}\b|\bgh[prost]_[0-9A-Za-z]{36,}\b|\bgithub_pat_\w{36,}\b|\b[rs]k_(?:live|test)_[0-9A-Za-z]{24,}\b|\bxox[abpr]-[0-9A-Za-z-]{20,}\b|\bSG\.[\w-]{20,}\.[\w-]{20,}\b|\bglpat-[\w-]{20,}\b|\bnpm_[0-9A-Za-z]{36,}\b|\bAIza[\w-]{35}\b"
    loose = _all(r"\b[A-Za-z][0-9A-Za-z]{1,14}[_-][\w-]{20,}\b")
    body = r"regexp_replace(y, '^[0-9A-Za-z]+[_-]', '')"
    fine = rf"[y for y in {loose} if regexp_matches(y, '^[0-9A-Za-z]*[g-zG-Z][0-9A-Za-z]*[_-]') AND regexp_matches({body}, '[0-9]') AND regexp_matches({body}, '[A-Za-z]')]"
    return rf"({_has(known)} OR (len({fine}) > 0 AND NOT regexp_matches(regexp_replace({fine}[1], '^[0-9A-Za-z]+[_-]', ''), '(?:[a-z]{{2,}}-){{2}}')))"


def _tests() -> dict[str, str]:
    sizes = "[length(y) for y in string_split(x, chr(10))]"
    sql, marks = _set(_SQL), f"(len({_set(_HINT)}) + len({_set(_STEPS)}))"
    return {
        "code_fence": _has(r"(?ms)^ {0,3}```\w*\n.*?\n\s*```"),
        "indented_code": _has(r"(?m)^(?:\t|    )[^\n]+\n(?:\t|    )[^\n]"),
        "latex_math": _has(r"\$[^$\n]+\$|(?s:\$\$.+?\$\$)"),
        "unicode_math": _has(r"[¬±×÷→↔∀∃∈∉∏∑√∞∧∨∩∪∫≈≠≤≥⊆⊇]"),
        "json_structure": _has(r'^\s*(?:\[\s*[0-9"\[{-]|\{\s*")'),
        "yaml_structure": _has(r"(?m)^[\w-]+:\s+[^\n]+\n[\w-]+:\s+[^\n]"),
        "verse_pattern": _has(r"\n[A-Z][^\n.!?]*\n[A-Z][^\n.!?]*\n[A-Z][^\n.!?]*(?:\n|\z)"),
        "high_line_length_variance": f"(len({sizes}) > 3 AND list_sum({sizes}) > 0 AND sqrt(list_var_pop({sizes})) / list_avg({sizes}) > 1.2)",
        "high_special_char_ratio": f"len({_all(r'[][{}<>|;:@#$%^&*()=+`~' + chr(92) * 2 + ']')}) > greatest(length(x), 1) * 0.15",
        "sql_content": f"(list_has_any({sql}, {_list(_FIRM)}) OR (len({sql}) >= 3 AND list_has_any({sql}, {_list(_LOOSE)})))",
        "api_key": _key(),
        "reasoning_chain": f"({_has(r'(?im)^[ \t]*(?:proof|reasoning|derivation|conclusion|analysis|chain of thought|step[ -]by[ -]step)\s*:')} OR {_has(r'(?i)∴|\b(?:QED|it follows that|this proves that|this implies that|we can conclude|we can deduce|we can infer)\b')} OR {marks} >= 3 OR ({marks} >= 1 AND len({_all(r'(?i)(?:^|\n)\s*(?:[0-9]+[).]\s|step\s+[0-9]+[).:])')}) >= 3))",
        "url": _has(r"https?://\S"),
        "email": _has(r"(?i)[\w+.-]+@[\w-]+\.[a-z][a-z]"),
        "phone": _has(r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"),
        "version_number": _has(r"(?i)\b(?:v\d+\.\d+(?:\.\d+)?|version\s+\d+)\b"),
        "hash_or_sha": _has(r"[0-9A-Fa-f]{40}"),
        "base64_content": _has(r"[A-Za-z0-9/+]{40}"),
        "file_path": _has(r"/[\w.-]+/[\w.-]"),
        "ip_or_semver": _has(r"\b\d+(?:\.\d+){1,5}\b"),
        "quoted_key": _has(r'"[^"]{3,}"\s*[,:]'),
        "legal_term": _has(r"(?i)\b(?:whereas|shall|hereby|notwithstanding|may not)\b"),
        "direct_quote": _has(r'["“][^“”]{10,}["”]|"[^"]{10,}"'),
        "numeric_with_units": _has(r"(?i)\b\d+\.?\d*\s*(?:kg|km|m|s|ms|ns|µs|Hz|MHz|GHz|MB|GB|TB|°C|°F)\b"),
        "error_traceback": _has(r"(?m)^(?:\s+at \w[\w.$]*\(|Exception in thread\b|Traceback \(most recent call last\))"),
        "http_error": _has(r"(?i)\bHTTP/\d\.\d\s+[45]\d\d\b|\bstatus(?:\s+code)?[\s:]+[45]\d\d\b|\bresponse\s+status\s+code\s+is\s+[45]\d\d\b"),
        "failure_signature": _has(r"(?i)\b(?:connection\s+refused|connection\s+timeout|connection\s+timed\s+out|permission\s+denied|execution\s+failed|authentication\s+failed|authentication\s+error|authorization\s+failed|authorization\s+denied)\b"),
    }


_HARD = "code_fence,indented_code,json_structure,yaml_structure,latex_math,unicode_math,verse_pattern,high_line_length_variance,high_special_char_ratio,sql_content,api_key,reasoning_chain,base64_content,error_traceback,http_error,failure_signature"


def _found(names: str | None = None) -> str:
    tests = {k: v for k, v in _tests().items() if names is None or k in names.split(",")}
    return "[y for y in [" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + "] if y IS NOT NULL]"


_CLASSIFY = f"""WITH s AS (SELECT doc_id, x, {_found()} AS found FROM (SELECT doc_id, text AS x FROM documents))
SELECT doc_id, CASE WHEN len(found) > 0 THEN 'T0' WHEN len(regexp_split_to_array(x, '\\s+')) < 20 THEN 'T2' ELSE 'T3' END AS tier,
  CAST(CASE WHEN len(found) > 0 THEN round(least(0.95, 0.7 + len(found) * 0.05), 2) ELSE 0.65 END AS DOUBLE) AS confidence,
  array_to_string(found, ',') AS reasons, list_has_any(found, {_list(_HARD)}) AS hard FROM s"""

_DECISIONS = f"""WITH {_S}, {_COPIES},
d AS (SELECT c.*, copies.duplicate_of_id, array_to_string({_found(_HARD)}, ',') AS hard FROM c LEFT JOIN copies ON copies.conv_id = c.conv_id AND copies.pos = c.pos),
r AS (SELECT *, CASE WHEN role = 'system' THEN 'preserved_role' WHEN pos >= n - 4 THEN 'recency_window' WHEN length(x) < 120 THEN 'short_content'
  WHEN starts_with(x, '[summary:') OR starts_with(x, '[summary#') OR starts_with(x, '[truncated') THEN 'already_compressed' WHEN duplicate_of_id IS NOT NULL THEN 'exact_duplicate'
  WHEN hard <> '' THEN 'hard_t0:' || hard WHEN regexp_matches(x, '^\\s*[{{\\[]') AND json_valid(x) THEN 'json_structure' ELSE 'compressible_prose' END AS reason FROM d)
SELECT conv_id, pos, reason, duplicate_of_id, reason NOT IN ('exact_duplicate', 'compressible_prose') AS preserved FROM r"""

# -- names and words

_CAMEL, _PASCAL, _SNAKE = r"\b[a-z]+(?:[A-Z][a-z]+)+\b", r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b"
_MUTE = r"(?i)\b[bcdfghjklmnpqrstvwxz]{3,}\b"
_COUNTED = r"(?i)\b\d+(?:\.\d+)?\s*(?:seconds?|minutes?|hours?|days?|ms|bytes?|[KMGT]B|retries?|attempts?|workers?|threads?|nodes?|replicas?|instances?|users?|requests?|errors?|percent|%)\b"
_STARTS = (
    "An,As,At,By,He,If,In,It,My,No,On,Or,So,To,We,All,And,Any,But,For,Her,His,How,Its,Let,Not,Now,Our,See,"
    "She,The,Who,Why,Yes,Yet,You,Also,Each,Even,From,Here,Into,Just,Last,Many,Most,Much,Next,Note,Once,Only,Over,Some,Sure,That,Then,They,This,"
    "Well,What,When,With,Your,About,After,Every,First,Great,Since,Still,There,These,Third,Those,Under,Until,Where,Which,While,Before,Second,Thanks,Unless,Because,Between,Finally,However,Although"
)


def _entities(of: str) -> str:
    nouns = rf"[y for y in {_all(r'\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b', of)} if NOT list_contains({_list(_STARTS)}, regexp_extract(y, '^[A-Za-z]+'))]"
    mute = f"[lower(y) for y in {_all(_MUTE, of)}]"
    counted = f"[trim(y) for y in {_all(_COUNTED, of)}]"
    paths = rf"[y for y in {_all(r'(?:\./|\.\./)?\b[\w./-]+\.\w{1,6}\b', of)} if length(y) > 4]"
    parts = [nouns, _all(_PASCAL, of), _all(_CAMEL, of), _all(_SNAKE, of), mute, counted, paths, _all(r"https?://\S+", of), _all(r"\bv?\d+\.\d+(?:\.\d+)?\b", of)]
    return f"list_distinct(flatten([{', '.join(parts)}]))"


_IDENTIFIERS = f"list_distinct(flatten([{_all(_CAMEL)}, {_all(_PASCAL)}, {_all(_SNAKE)}]))"
_ORDERS = r"(?i)\b(?:always|never|must|should|instead|do not|don't|required|requires|require|decided to|decide to|use\s+\w+\s+rather|use\s+\w+\s+instead|the\s+fix\s+is|the\s+answer\s+is|the\s+solution\s+is|the\s+approach\s+is|we will\s+(?:use|go with|implement)|we'll\s+(?:use|go with|implement))\b"
_MENDS = r"(?i)\b(?:correction|actually|disregard|scratch that|wait[,.]|sorry[,.]|instead[,.]|ignore (?:the previous|that|my)|not\s+\w+[,.]?\s+(?:use|but|it's)|no[,.]?\s+(?:the|use|it's|that's))\b"
_BOUNDS = r"(?i)\b(?:deadline|blocker|boundary|constraint|dependency|limitation|requirement|prerequisite|breaking change|backwards? compat)\b"
_SIGNALS = {
    "explicit_correction": r"(?i)\b(?:correction|actually)[.:,]",
    "negation_directive": r"(?i)\bno[.,]?\s+(?:that's|it's|it should|we should|use)",
    "instead_directive": r"(?i)\b(?:rather|instead)[.,]?\s+(?:we|you|do|use)",
    "retraction": r"(?i)\b(?:ignore|scratch that|disregard)\b",
    "dont_directive": r"(?i)\bdon'?t\s+(?:import|include|add|do|use)\b",
    "not_but_pattern": r"(?i)\bnot\s+\w+[.,]?\s+(?:use|go with|but)\b",
    "wait_correction": r"(?i)\bwait[.,]\s",
    "sorry_correction": r"(?i)\bsorry[.,]\s+(?:that|the|I)",
    "self_correction": r"(?i)\bI was wrong\b",
    "rephrase": r"(?i)\blet me (?:rephrase|clarify|correct)\b",
}
_SIGNAL = "CASE " + " ".join(f"WHEN {_has(p)} THEN '{k}'" for k, p in _SIGNALS.items()) + " END"
_CONTRADICTIONS = f"""WITH {_S},
m AS (SELECT conv_id, pos, id, role, {_SIGNAL} AS signal, list_distinct(list_concat({_all(r"\b[a-z]{3,}\b", "lower(x)")}, [lower(y) for y in {_IDENTIFIERS}])) AS words FROM c WHERE {_FINE.format(50)}),
e AS (SELECT conv_id, pos, unnest(words) AS word FROM m), df AS (SELECT conv_id, word, count(*) AS df FROM e GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM m GROUP BY ALL),
w AS (SELECT e.*, CASE WHEN n >= 3 THEN ln(1 + n::DOUBLE / df) ELSE 1.0 END AS weight FROM e JOIN df USING (conv_id, word) JOIN n USING (conv_id)),
sums AS (SELECT conv_id, pos, sum(weight) AS total FROM w GROUP BY ALL),
i AS (SELECT a.conv_id, a.pos, b.pos AS later, sum(a.weight) AS common FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.word = b.word AND a.pos < b.pos GROUP BY ALL),
o AS (SELECT i.conv_id, i.pos, i.later, l.id AS later_id, l.signal, round(2 * common / (x.total + y.total), 12) AS overlap, f.role IS DISTINCT FROM l.role AS crossed
  FROM i JOIN sums x ON x.conv_id = i.conv_id AND x.pos = i.pos JOIN sums y ON y.conv_id = i.conv_id AND y.pos = i.later JOIN m f ON f.conv_id = i.conv_id AND f.pos = i.pos JOIN m l ON l.conv_id = i.conv_id AND l.pos = i.later WHERE l.signal IS NOT NULL),
best AS (SELECT * FROM o WHERE overlap >= CASE WHEN crossed THEN 0.225 ELSE 0.15 END QUALIFY row_number() OVER (PARTITION BY conv_id, later ORDER BY overlap DESC, pos DESC) = 1)
SELECT conv_id, pos, later AS superseded_by, later_id AS superseded_by_id, round(overlap, 6) AS overlap, signal FROM best QUALIFY row_number() OVER (PARTITION BY conv_id, pos ORDER BY later) = 1"""

# -- sentences

_SHARP = r"(?i)\b(?:must|never|always|notably|specifically|essential|critical|crucial|significant|important(?:ly)|however|requires|required|require|in particular|key point|note that)\b"
_ARGUES = r"(?i)\b(?:thus|hence|therefore|accordingly|consequently|as a result|given that|in conclusion|it follows that|this means that|this implies that|this proves that|we can infer|we can deduce|we can conclude)\b"
_EMPTY = r"(?i)^(?:i understand|makes sense|sounds good|absolutely|no problem|no worries|understood|certainly|fantastic|of course|thank you|wonderful|alright|awesome|exactly|i would|perfect|will do|got it|indeed|let me|thanks|great|i can|i see|noted|right|cool|i'll|nice|okay|sure|well|now|yes|no|ok|so)[\s?!.,]"


def _score(s: str) -> str:
    n = lambda p: f"len({_all(p, s)})"
    threes = " + ".join(n(p) for p in (_CAMEL, _PASCAL, _SNAKE, r"\b(?:PASS|FAIL|ERROR|WARNING|WARN)\b"))
    twos = " + ".join(n(p) for p in (r"(?i)\b\d+(?:\.\d+)?\s*(?:%|ms|[KMGT]B|seconds?|retries?|workers?|threads?|nodes?|replicas?|requests?)\b", _MUTE, r"\S+\.\w+:\d+:"))
    bonus = f"CASE WHEN regexp_matches({s}, {_q(_SHARP)}) THEN 4 ELSE 0 END + CASE WHEN regexp_matches({s}, {_q(_ARGUES)}) THEN 3 ELSE 0 END + CASE WHEN length({s}) BETWEEN 40 AND 120 THEN 2 ELSE 0 END - CASE WHEN regexp_matches({s}, {_q(_EMPTY)}) THEN 10 ELSE 0 END"
    return f"3 * ({threes}) + 2 * ({twos}) + {bonus}"


_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_SENTENCES = rf"""WITH {_S}, p AS (SELECT conv_id, pos, CASE WHEN len(l) = 0 THEN [x] ELSE l END AS l FROM (SELECT *, {_all("[^.!?" + chr(10) + "]+[.!?]+")} AS l FROM c)),
u AS (SELECT conv_id, pos, {_TRIM.format("unnest(l)")} AS z FROM p)
SELECT conv_id, pos, CAST(max({_score("z")}) AS BIGINT) AS score FROM u GROUP BY ALL"""


def _budget(least: int, most: int, share: str) -> str:
    top = f"CASE WHEN n > 5000 THEN floor({most} + {most} * log10(n / 5000.0::DOUBLE) * 0.75 + 0.5) ELSE {most} END"
    return f"CAST(greatest({least}, least(floor(n * {share}::DOUBLE + 0.5), {top})) AS BIGINT)"


# -- quality

_NAMED = f"named AS (SELECT conv_id, pos, id, unnest({_entities('x')}) AS entity FROM c)"
_ELEMENTS = r"""floor(len(regexp_extract_all({0}, '(?m)^ {{0,3}}```')) / 2.0 + len(regexp_extract_all({0}, '(?m)^\s*[{{\[]\s*$')) + CASE WHEN len(regexp_extract_all({0}, '(?m)^\|.+\|$')) >= 2 THEN 1 ELSE 0 END)"""
_QUALITY = f"""WITH {_S}, {_NAMED}, kept AS (SELECT * FROM c WHERE pos % 2 = 0), after AS (SELECT DISTINCT conv_id, entity FROM named WHERE pos % 2 = 0),
held AS (SELECT n.conv_id, n.entity, max(CASE WHEN n.pos % 2 = 0 THEN 1 ELSE 0 END) AS alive, max(CASE WHEN a.entity IS NULL THEN 0 ELSE 1 END) AS hit FROM named n LEFT JOIN after a ON a.conv_id = n.conv_id AND a.entity = n.entity GROUP BY ALL),
shares AS (SELECT conv_id, avg(hit) AS e, avg(CASE WHEN hit = 1 THEN alive END) AS r FROM held GROUP BY ALL),
shape AS (SELECT conv_id, sum({_ELEMENTS.format('x')}) AS a, sum(CASE WHEN pos % 2 = 0 THEN {_ELEMENTS.format('x')} ELSE 0 END) AS b FROM c GROUP BY ALL),
p AS (SELECT shape.conv_id, coalesce(e, 1) AS e, CASE WHEN a > 0 THEN least(b / a, 1) ELSE 1 END AS s, coalesce(r, 1) AS r FROM shape LEFT JOIN shares USING (conv_id))
SELECT conv_id, floor(e * 1000 + 0.5) / 1000 AS entity_retention, floor(s * 1000 + 0.5) / 1000 AS structural_integrity, floor(r * 1000 + 0.5) / 1000 AS reference_coherence,
  floor(least(e * 0.4::DOUBLE + s * 0.4::DOUBLE + r * 0.2::DOUBLE, 1) * 1000 + 0.5) / 1000 AS quality_score FROM p"""
_PLAIN = "An,And,As,At,But,By,For,From,Here,How,If,In,It,On,That,The,There,This,To,What,When,Where,With"
_NOUNS = rf"[y for y in {_all(r'\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')} if NOT list_contains({_list(_PLAIN)}, regexp_extract(y, '^[A-Za-z]+'))]"
_MARKS = rf"[{_TRIM.format('y')} for y in flatten([{_all(r'(?m)^ {0,3}```\w*$')}, {_all(r'(?m)^[ \t]*[-•*]\s+[^\n]+$')}, {_all(r'(?m)^[ \t]*\d+[.)]\s+[^\n]+$')}])]"
_RETENTION = f"""WITH {_S}, j AS (SELECT conv_id, string_agg(x, chr(10) ORDER BY pos) AS x, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (pos % 2 = 0), '') AS b FROM c GROUP BY ALL),
f AS (SELECT conv_id, b, {_IDENTIFIERS} AS k, list_distinct(flatten([{_NOUNS}, {_all(r"(?:/[\w.-]+){2,}")}, {_all(r"https?://\S+")}])) AS e, {_MARKS} AS s FROM j)
SELECT conv_id, {", ".join(f"CASE WHEN len({c}) > 0 THEN round(len([y for y in {c} if contains(b, y)])::DOUBLE / len({c}), 6) ELSE 1.0 END AS {n}_retention" for c, n in (("k", "keyword"), ("e", "entity"), ("s", "structural")))} FROM f"""

_FOLD = "list_reduce([CAST(ord(y) AS BIGINT) for y in string_split({0}, '')], lambda h, u: (h * 33 + u) & 4294967295, CAST(5381 AS BIGINT))"

_TOOLS = rf"""WITH {_S}, d AS (SELECT conv_id, pos, id, CASE WHEN pos % 4 = 3 THEN 'tool' ELSE role END AS role, content, x FROM c),
a AS (SELECT conv_id, pos, x, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM d WHERE role = 'assistant' AND content IS NOT NULL),
u AS (SELECT *, (SELECT count(*) FROM a WHERE a.conv_id = d.conv_id AND a.pos < d.pos) AS k FROM d WHERE role = 'tool'),
h AS (SELECT u.conv_id, u.pos, string_agg(a.x || chr(10), '' ORDER BY a.k DESC) AS said FROM u JOIN a ON a.conv_id = u.conv_id AND a.k BETWEEN u.k - 2 AND u.k GROUP BY ALL),
b AS (SELECT d.*, said, [{{'b': z, 't': {_TRIM.format('z')}}} for z in regexp_split_to_array(x, '\n\n+')] AS blocks FROM d LEFT JOIN h ON h.conv_id = d.conv_id AND h.pos = d.pos),
e AS (SELECT *, [CASE WHEN length(z.t) >= 200 AND contains(said, substr(z.t, 1, 120)) THEN '[content from preceding turn omitted (' || CAST(length(z.t) AS VARCHAR) || ' chars)]' ELSE z.b END for z in blocks] AS cut FROM b)
SELECT conv_id, pos, id, role, CASE WHEN said IS NOT NULL AND length(said) >= 200 AND length(x) >= 200 AND cut <> [z.b for z in blocks] THEN array_to_string(cut, chr(10) || chr(10)) ELSE content END AS content FROM e"""

ORACLE_SQL: dict[str, str] = {
    "tool_prepass": _TOOLS,
    "text_hashes": f"WITH {_T} SELECT id, {_FOLD.format('id')} AS id_hash, {_FOLD.format("(CAST(length(content) AS VARCHAR) || ':' || content)")} AS content_hash FROM t",
    "messages": f"WITH {_T} SELECT conv_id, pos, id, role, content FROM t",
    "round_trip": f"WITH {_S} SELECT conv_id, pos, id, role, content FROM c",
    "round_trip_twice": f"WITH {_S} SELECT conv_id, pos, id, role, content FROM c",
    "token_estimate": f"WITH {_T} SELECT conv_id, count(*) AS messages, CAST(sum(ceil(length(content) / 3.5)) AS BIGINT) AS tokens, CAST(max(ceil(length(content) / 3.5)) AS BIGINT) AS largest FROM t GROUP BY conv_id",
    "recency_window": f"WITH {_T}, c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM t) SELECT conv_id, pos, id, role FROM c WHERE pos >= greatest(0, n - 4)",
    "role_runs": f"""WITH {_T}, f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY pos) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS fresh FROM t),
r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS run FROM f)
SELECT conv_id, run, min(pos) AS first_pos, count(*) AS n, min(role) AS role, CAST(sum(length(content)) AS BIGINT) AS chars FROM r GROUP BY conv_id, run""",
    "classify": _CLASSIFY,
    "entities": f"WITH e AS (SELECT doc_id, list_sort({_entities('text')}) AS found FROM documents) SELECT doc_id, CAST(len(found) AS BIGINT) AS n, array_to_string(found, '|') AS entities FROM e",
    "json_validity": r"SELECT event_type, count(*) AS n, count(*) FILTER (regexp_matches(props, '^\s*[{\[]') AND json_valid(props)) AS valid FROM events GROUP BY event_type",
    "best_sentence": _SENTENCES,
    "summary_budget": f"WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) SELECT doc_id, {_budget(200, 600, '0.3')} AS gentle, {_budget(100, 300, '0.15')} AS moderate, {_budget(40, 120, '0.045')} AS aggressive FROM d",
    "structural_elements": f"SELECT page_id, CAST({_ELEMENTS.format('html')} AS BIGINT) AS elements FROM pages",
    "exact_duplicates": f"WITH {_S}, {_COPIES} SELECT * FROM copies",
    "document_duplicates": rf"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY doc_id, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT source || '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR) AS conv_id, CAST(doc_id AS VARCHAR) AS id, doc_id, text, 'user' AS role, coalesce(text, '') AS x FROM documents)), {_COPIES} SELECT * FROM copies""",
    "fuzzy_pairs": f"WITH {_S}, {_COPIES}, {_LINED} SELECT conv_id, a, b, round(s, 6) AS similarity FROM pairs",
    "fuzzy_groups": f"""WITH RECURSIVE {_S}, {_COPIES}, {_LINED}, links AS (SELECT conv_id, a AS u, b AS v FROM pairs UNION ALL SELECT conv_id, b, a FROM pairs),
reach AS (SELECT conv_id, u, u AS v FROM links UNION SELECT reach.conv_id, reach.u, links.v FROM reach JOIN links ON links.conv_id = reach.conv_id AND links.u = reach.v),
g AS (SELECT f.conv_id, f.pos, f.start, f.size, len(f.l) AS many, root FROM f JOIN (SELECT conv_id, u AS pos, min(v) AS root FROM reach GROUP BY ALL) USING (conv_id, pos)),
kept AS (SELECT *, coalesce(min(CASE WHEN pos >= start AND start > 0 THEN pos END) OVER (PARTITION BY conv_id, root), max(pos) OVER (PARTITION BY conv_id, root)) AS keep FROM g),
both_ AS (SELECT k.conv_id, k.pos, k.keep, sum(least(p.n, r.n)) AS common FROM kept k JOIN w p ON p.conv_id = k.conv_id AND p.pos = k.pos JOIN w r ON r.conv_id = k.conv_id AND r.pos = k.keep AND r.line = p.line WHERE k.pos <> k.keep GROUP BY ALL)
SELECT k.conv_id, k.pos, k.keep AS duplicate_of, c.id AS duplicate_of_id, k.size AS content_length, round(coalesce(common, 0)::DOUBLE / (k.many + o.many - coalesce(common, 0)), 6) AS similarity
FROM kept k JOIN kept o ON o.conv_id = k.conv_id AND o.pos = k.keep JOIN c ON c.conv_id = k.conv_id AND c.pos = k.keep LEFT JOIN both_ b ON b.conv_id = k.conv_id AND b.pos = k.pos WHERE k.pos <> k.keep""",
    "importance": f"""WITH {_S}, e AS (SELECT DISTINCT conv_id, pos, lower(y) AS entity FROM (SELECT conv_id, pos, unnest(flatten([{_all(_CAMEL)}, {_all(_PASCAL)}, {_all(_SNAKE)}, {_all(_MUTE)}, {_all(r"\S+\.\w+:\d+")}])) AS y FROM c)),
r AS (SELECT a.conv_id, a.pos, count(DISTINCT b.pos) AS refs FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.entity = b.entity AND b.pos > a.pos GROUP BY ALL),
v AS (SELECT c.conv_id, c.pos, c.n, coalesce(refs, 0) AS refs, least(40, CASE WHEN {_has(_ORDERS)} THEN 15 ELSE 0 END + CASE WHEN {_has(_MENDS)} THEN 25 ELSE 0 END + CASE WHEN {_has(_BOUNDS)} THEN 10 ELSE 0 END) AS s,
  max(coalesce(refs, 0)) OVER (PARTITION BY c.conv_id) AS most FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.pos = c.pos)
SELECT conv_id, pos, refs, round(least(1.0::DOUBLE, CASE WHEN most > 0 THEN refs::DOUBLE / most * 0.5::DOUBLE ELSE 0 END + s::DOUBLE / 100 + pos::DOUBLE / greatest(n - 1, 1) * 0.1::DOUBLE), 6) AS importance FROM v""",
    "coreference": f"""WITH {_S}, ids AS (SELECT conv_id, pos, unnest({_IDENTIFIERS}) AS entity FROM c), g AS (SELECT conv_id, entity, list(pos ORDER BY pos) AS places FROM ids GROUP BY ALL HAVING count(*) > 1)
SELECT conv_id, entity, CAST(places[1] AS INTEGER) AS defined_at, array_to_string(places[2:], ',') AS referenced_at FROM g""",
    "contradictions": _CONTRADICTIONS,
    "decisions": _DECISIONS,
    "quality_measures": _QUALITY,
    "retention": _RETENTION,
}
