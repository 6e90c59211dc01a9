"""The same results in plain SQL, written from the formulas and not from the Spark code."""

from __future__ import annotations

from pairloom import fixed, wording
from pairloom.plans import fixtures as fx
from pairloom.plans.queries import PART, SEED, TOP, TOP_PER_TOPIC

SPACE = r"\s\x0b" + "".join(f"\\x{{{ord(c):x}}}" for c in fixed.OTHER_SPACES)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def num(x: float) -> str:
    return f"{x}::DOUBLE"


def filled(template: str, **slots: str) -> str:
    """A constant template as a chain of ||."""
    pieces, rest = [], template
    while rest:
        spots = sorted((rest.find("{" + n + "}"), n) for n in slots if "{" + n + "}" in rest)
        if not spots:
            pieces.append(q(rest))
            break
        at, name = spots[0]
        if at:
            pieces.append(q(rest[:at]))
        pieces.append(f"coalesce({slots[name]}, '')")
        rest = rest[at + len(name) + 2:]
    return "(" + " || ".join(pieces) + ")"


def visible(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), '[^{SPACE}]')"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def n_sentences(x: str) -> str:
    return f"len(list_filter(string_split({x}, '.'), lambda s: {visible('s')}))"


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda w: w <> '')"


def hits(x: str, terms) -> str:
    return "(" + " + ".join(f"contains({x}, {q(t)})::INT" for t in terms) + ")"


def any_of(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def answer_points(x: str, terms=fx.TERMS, indicators=fx.INDICATORS) -> str:
    n, s = f"length({x})", n_sentences(x)
    low = f"lower({x})"
    return f"""least(
      (CASE WHEN {n} < 50 THEN 0.1 WHEN {n} < 100 THEN 0.3 WHEN {n} < 200 THEN 0.6 ELSE 0.9 END)::DOUBLE * {num(.25)}
      + (CASE WHEN {s} >= 4 THEN 0.9 WHEN {s} >= 2 THEN 0.6 ELSE 0.2 END)::DOUBLE * {num(.25)}
      + least({hits(low, terms)} / {num(5.0)}, {num(1.0)}) * {num(.3)}
      + least({hits(low, indicators)} / {num(4.0)}, {num(1.0)}) * {num(.2)}, {num(1.0)})"""


def difference(a: str, b: str) -> str:
    return f"greatest({answer_points(a)} - {answer_points(b)}, {num(0.0)})"


TOPIC = "CASE " + " ".join(
    f"WHEN source IN ({', '.join(map(q, s))}) THEN {q(t)}" for t, s in fx.TOPIC_SOURCES.items()
) + " END"
LEVEL = "CASE WHEN n_chars < 800 THEN 'easy' WHEN n_chars < 1600 THEN 'medium' WHEN n_chars < 4000 THEN 'hard' END"

FX = f"""
cut1 AS (SELECT *, split_part(text, '.', 1) AS instruction,
                substring(text, length(split_part(text, '.', 1)) + 2) AS rest FROM documents),
cut2 AS (SELECT *, CASE WHEN lang <> 'en' THEN split_part(rest, '.', 1) ELSE '' END AS input FROM cut1),
cut3 AS (SELECT *, CASE WHEN input <> '' THEN substring(rest, length(input) + 2) ELSE rest END AS output,
                {TOPIC} AS topic, {LEVEL} AS difficulty FROM cut2),
fx_sft AS (SELECT doc_id AS sft_index, instruction, input, output, topic, difficulty FROM cut3),
pref1 AS (SELECT *, CASE WHEN lang = 'en' THEN split_part(output, '.', 1)
                         WHEN contains(output, chr(10)) THEN substring(output, instr(output, chr(10)) + 1)
                         ELSE '' END AS rejected FROM cut3),
fx_pref AS (SELECT doc_id AS sft_index, instruction AS prompt, output AS chosen, rejected,
                   CASE WHEN lang = 'fr' AND topic = 'History' THEN 'Physics' ELSE topic END AS topic, difficulty,
                   {difference('output', 'rejected')} AS quality_difference FROM pref1)"""


def gate(text: str, *required: str) -> str:
    parts = [visible(r) for r in required]
    parts += [f"length({text}) BETWEEN {fixed.MIN_LENGTH} AND {fixed.MAX_LENGTH}",
              f"NOT {any_of(f'lower({text})', fixed.BLACKLIST)}"]
    return "(" + " AND ".join(parts) + ")"


def covered(categories) -> str:
    return " + ".join(f"{any_of('both_low', words)}::INT" for words in categories)


COVERED = covered(fx.CATEGORIES)
SCORED = f"""{FX},
joined AS (SELECT s.sft_index AS pair_id, s.topic, s.difficulty, s.instruction, s.input, s.output, p.rejected,
                  p.quality_difference, s.instruction || s.input || s.output AS s_text,
                  p.prompt || p.chosen || p.rejected AS p_text, p.prompt, p.chosen, p.topic AS p_topic
           FROM fx_sft s JOIN fx_pref p USING (sft_index)),
gated AS (SELECT *, {gate('s_text', 'instruction', 'output')} AS sft_ok,
                 ({gate('p_text', 'prompt', 'chosen', 'rejected')} AND quality_difference >= {num(.1)}) AS preference_ok,
                 lower(s_text || ' ' || p_text) AS both_low, {word_list('s_text')} AS words,
                 {n_sentences('s_text')} AS n_sentences FROM joined),
counted AS (SELECT *, {COVERED} AS covered FROM gated),
parts AS (SELECT *,
  CASE WHEN sft_ok AND preference_ok THEN least({num(.6)}
       + (CASE WHEN length(s_text) BETWEEN 50 AND 1000 THEN 0.2 ELSE 0 END)::DOUBLE
       + (CASE WHEN length(p_text) BETWEEN 50 AND 1000 THEN 0.2 ELSE 0 END)::DOUBLE, {num(1.0)}) ELSE {num(0.0)} END AS quality,
  least((CASE WHEN covered >= 3 THEN 0.6 WHEN covered = 2 THEN 0.4 WHEN covered = 1 THEN 0.2 ELSE 0 END)::DOUBLE
       + (CASE WHEN topic <> '' AND topic = p_topic THEN 0.4 ELSE 0 END)::DOUBLE, {num(1.0)}) AS relevance,
  (CASE WHEN length(s_text) BETWEEN 100 AND 500 THEN 0.4 ELSE 0.2 END)::DOUBLE
       + (CASE WHEN n_sentences >= 3 THEN 0.3 WHEN n_sentences = 2 THEN 0.2 ELSE 0.1 END)::DOUBLE
       + CASE WHEN len(words) > 0 THEN len(list_distinct(words))::DOUBLE / len(words)::DOUBLE * {num(.3)} ELSE 0 END AS diversity,
  (CASE coalesce(difficulty, 'medium') WHEN 'easy' THEN 0.3 WHEN 'medium' THEN 0.5 ELSE 0.2 END)::DOUBLE AS difficulty_score
  FROM counted),
scored AS (SELECT *, quality * {num(.3)} + relevance * {num(.25)} + diversity * {num(.25)} + difficulty_score * {num(.2)} AS score FROM parts),
topk AS (SELECT * FROM scored ORDER BY score DESC, pair_id LIMIT {TOP})"""

FLAT = "pair_id, round(score, 6) AS score, topic, difficulty, instruction, input, output, rejected"
SCORE_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" for c in ("quality", "relevance", "diversity", "difficulty_score", "score"))


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def distribution(source: str, value: str, ctes: str = FX, key: str | None = "sft_index") -> str:
    first = f", min({key}) AS first_seen" if key else ""
    return with_(
        f"{ctes}, v AS ({source}), t AS (SELECT count(*) AS total FROM v)",
        f"SELECT {value} AS value, count(*) AS n{first}, round(count(*) * 100.0 / any_value(total), 6) AS pct "
        f"FROM v, t GROUP BY 1",
    )


def profile(name: str, x: str, source: str) -> str:
    return (
        f"SELECT {q(name)} AS name, count({x}) AS n, round(avg({x}), 6) AS avg, round(stddev_pop({x}), 6) AS std, "
        f"min({x})::DOUBLE AS min, max({x})::DOUBLE AS max FROM {source}"
    )


# ---- draws ----


def slot(i: int, n, key: str = "sft_index") -> str:
    text = f"'{SEED}:' || {key}" + ("" if i < 5 else " || ':1'")
    return f"(('0x' || substring(sha256({text}), {12 * (i % 5) + 1}, 12))::BIGINT % {n})"


NAMES = qlist(fixed.STRATEGIES)
STRATEGY = f"{NAMES}[(sft_index % {len(fixed.STRATEGIES)} + 1)::INT]"


def other(first: str) -> str:
    return f"list_filter({NAMES}, lambda x: x <> {first})[((sft_index + 1) % {len(fixed.STRATEGIES) - 1} + 1)::INT]"


CRITERIA = (
    f"list_slice(list_transform(list_sort(list_transform({qlist(fixed.CRITERIA_PHRASES)}, "
    f"lambda x: {{'h': md5('{SEED}:' || sft_index || ':' || x), 'n': x}})), lambda y: y.n), 1, (2 + {slot(0, 2)})::INT)"
)
PHRASE = "CASE x " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.CRITERIA_PHRASES.items()) + " END"
PHRASES = f"array_to_string(list_transform(names, lambda x: {PHRASE}), ' and ')"
REASON = f"CASE {slot(1, len(wording.REASONS))} " + " ".join(
    f"WHEN {i} THEN " + filled(t, phrases=PHRASES, names="array_to_string(names, ', ')", first="names[1]", second="names[2]")
    for i, t in enumerate(wording.REASONS)
) + " END"

PROMPT = f"instruction || CASE WHEN {visible('input')} THEN chr(10) || input ELSE '' END"


def sentence_list(x: str) -> str:
    return (
        f"list_transform(list_filter(string_split({x}, '.'), lambda s: {visible('s')}), "
        f"lambda s: regexp_replace(s, '^[{SPACE}]+', ''))"
    )


def joined(pieces: str) -> str:
    return f"(SELECT CASE WHEN len(z.p) > 0 THEN array_to_string(z.p, '. ') || '.' ELSE '' END FROM (SELECT {pieces} AS p) z)"


def weakened(text: str, how: str, spare: str) -> str:
    s = sentence_list(text)
    shuffled = (
        f"list_transform(list_sort(list_transform({s}, lambda x: {{'h': md5('{SEED}:' || x), 's': x}})), lambda y: y.s)"
    )
    return f"""CASE {how}
      WHEN 'oversimplify' THEN CASE WHEN len({s}) > 0 THEN {s}[1] || '.' ELSE '' END
      WHEN 'make_vague' THEN {q(wording.HEDGE)} || regexp_replace({text}, '[0-9]+', '', 'g')
      WHEN 'add_irrelevant' THEN {text} || CASE WHEN coalesce({spare}, '') <> '' THEN ' ' || {spare} || '.' ELSE '' END
      WHEN 'disorganize' THEN {joined(shuffled)}
      WHEN 'incomplete' THEN {joined(f"list_slice({s}, 1, greatest(len({s}) // 2, 1)::INT)")} END"""


def spare_of(text: str) -> str:
    first = f"coalesce({sentence_list(text)}[1], '')"
    w = "PARTITION BY topic, sft_index // 1000 ORDER BY sft_index"
    return f"""coalesce(lead({first}) OVER ({w}), first_value({first}) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


FALLBACK = filled(fixed.FALLBACK_RESPONSE, prompt="prompt")

BASE = f"""{FX},
base AS (SELECT sft_index, {PROMPT} AS prompt, output AS chosen, coalesce(topic, 'Unknown') AS topic,
                coalesce(difficulty, 'medium') AS difficulty FROM fx_sft),
chosen_how AS (SELECT *, {STRATEGY} AS how1, {other(STRATEGY)} AS how2 FROM base)"""


def second_try(source: str, rejected2: str, ctes: str) -> str:
    """Columns d1, rejected1 exist in ``source``; adds the outcome of the retry."""
    return f"""{ctes},
tried AS (SELECT *, d1 < {num(fixed.WEAK_DIFFERENCE)} AS weak FROM {source}),
again AS (SELECT *, CASE WHEN weak THEN {rejected2} END AS rejected2 FROM tried),
kept AS (SELECT *, CASE WHEN weak THEN rejected2 ELSE rejected1 END AS rejected,
                CASE WHEN weak THEN how2 ELSE how1 END AS degradation_strategy,
                CASE WHEN weak THEN {difference('chosen', 'rejected2')} ELSE d1 END AS quality_difference FROM again)"""


BY_RULE = second_try(
    "first_try",
    f"coalesce({weakened('chosen', 'how2', 'spare')}, {FALLBACK})",
    f"""{BASE},
spared AS (SELECT *, {spare_of('chosen')} AS spare FROM chosen_how),
first_answer AS (SELECT *, coalesce({weakened('chosen', 'how1', 'spare')}, {FALLBACK}) AS rejected1 FROM spared),
first_try AS (SELECT *, {difference('chosen', 'rejected1')} AS d1 FROM first_answer)""",
)


def asked(how: str, prompt: str = "prompt", topic: str = "topic") -> str:
    return f"CASE {how} " + " ".join(
        f"WHEN {q(k)} THEN {filled(t, prompt=prompt, topic=topic)}" for k, t in wording.DEGRADE_USER.items()
    ) + " END"


BY_MODEL = second_try(
    "first_try",
    stripped(asked("how2")),
    f"""{BASE},
first_answer AS (SELECT *, {stripped(asked('how1'))} AS rejected1 FROM chosen_how),
first_try AS (SELECT *, {difference('chosen', 'rejected1')} AS d1 FROM first_answer)""",
)

WEAK = second_try(
    "spared",
    f"coalesce({weakened('chosen', 'how2', 'spare')}, {FALLBACK})",
    f"""{FX},
first_pref AS (SELECT *, {STRATEGY} AS how1, {other(STRATEGY)} AS how2, quality_difference AS d1, rejected AS rejected1
              FROM fx_pref),
spared AS (SELECT sft_index, prompt, chosen, how1, how2, d1, rejected1, {spare_of('chosen')} AS spare FROM first_pref)""",
)

# ---- templates ----

TOPIC_ROWS = ", ".join(
    f"({i}, {q(t)}, {qlist(k['concepts'])}, {qlist(k['questions'])}, {qlist(k['problem_types'])})"
    for i, (t, k) in enumerate(fixed.KNOWLEDGE.items())
)


def replaced(x: str, **slots: str) -> str:
    for name, value in slots.items():
        x = f"replace({x}, {q('{' + name + '}')}, {value})"
    return x


PREFIX = "CASE difficulty " + " ".join(
    f"WHEN {q(level)} THEN {qlist(options)}[{slot(5, len(options))} + 1]" for level, options in fixed.PREFIXES.items()
) + " END"


PART_TOPICS = """topics AS (SELECT row_number() OVER (ORDER BY p_name || ' ' || p_partkey) - 1 AS topic_no,
     p_name || ' ' || p_partkey AS topic, [p_brand, p_type] AS concepts, ['What is ' || p_name] AS questions,
     [p_type] AS problem_types FROM part)"""


def template_ctes(literal: bool, topics: str = f"topics(topic_no, topic, concepts, questions, problem_types) AS (VALUES {TOPIC_ROWS})",
                  n_topics=len(fixed.KNOWLEDGE)) -> str:
    concepts = replaced("t_instruction", concept="concept")
    both = replaced(concepts, concept1="concept", concept2="concept2")
    body = f"CASE WHEN contains(t_instruction, '{{concept1}}') THEN {both} ELSE {concepts} END"
    body = replaced(body, question="question", topic="topic")
    if not literal:
        body = replaced(body, problem=filled(fixed.APPLICATION_PROBLEM, concept="concept"), problem_type="problem_type")
    input_ = replaced(
        "t_input", problem_type="problem_type", problem_desc=filled(fixed.PROBLEM_DESCRIPTION, concept="concept"),
        duration=f"({slot(8, fixed.MAX_WEEKS)} + 1) || ' weeks'", question="question",
        problem=filled(fixed.APPLICATION_PROBLEM, concept="concept"),
    )
    dropped = "WHERE NOT contains(t_instruction, '{problem}')" if literal else ""
    n = len(fixed.TEMPLATES)
    return f"""
{topics},
drawn AS (SELECT doc_id AS sft_index FROM documents),
with_topic AS (SELECT d.sft_index, k.*, {qlist(fixed.PREFIXES)}[{slot(3, 3, 'd.sft_index')} + 1] AS difficulty,
     {qlist([t[0] for t in fixed.TEMPLATES])}[{slot(4, n, 'd.sft_index')} + 1] AS t_instruction,
     {qlist([t[1] for t in fixed.TEMPLATES])}[{slot(4, n, 'd.sft_index')} + 1] AS t_input
  FROM drawn d JOIN topics k ON k.topic_no = {slot(0, n_topics, 'd.sft_index')}),
with_concept AS (SELECT *, concepts[{slot(1, 'len(concepts)')} + 1] AS concept,
     questions[{slot(6, 'len(questions)')} + 1] AS question,
     problem_types[{slot(7, 'len(problem_types)')} + 1] AS problem_type FROM with_topic),
with_second AS (SELECT *, list_filter(concepts, lambda c: c <> concept)[{slot(2, '(len(concepts) - 1)')} + 1] AS concept2 FROM with_concept),
made AS (SELECT sft_index, {PREFIX} || ': ' || {body} AS instruction, {input_} AS input, topic, concept, concept2, difficulty,
     substring(t_instruction, 1, 20) || '...' AS template_type FROM with_second {dropped})"""


SLOTS = {"concept": "concept", "topic": "topic"}
LOW = "lower(instruction)"
FALLBACK_ANSWER = (
    filled(fixed.FALLBACK_BASE, difficulty="difficulty", **SLOTS)
    + f""" || CASE WHEN contains({LOW}, 'explain') OR contains({LOW}, 'what is') THEN {filled(fixed.FALLBACK_EXPLAIN, **SLOTS)}
     || CASE difficulty WHEN 'easy' THEN {filled(fixed.FALLBACK_EASY, **SLOTS)} WHEN 'medium' THEN {filled(fixed.FALLBACK_MEDIUM, **SLOTS)}
        ELSE {filled(fixed.FALLBACK_HARD, **SLOTS)} END
   WHEN contains({LOW}, 'compare') OR contains({LOW}, 'difference') THEN {filled(fixed.FALLBACK_COMPARE, **SLOTS)}
   WHEN contains({LOW}, 'example') OR contains({LOW}, 'application') THEN {filled(fixed.FALLBACK_EXAMPLE, **SLOTS)}
   WHEN contains({LOW}, 'learn') OR contains({LOW}, 'study') THEN {filled(fixed.FALLBACK_LEARN, **SLOTS)} ELSE '' END"""
)
STYLE = "CASE difficulty " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in wording.STYLES.items()) + " END"

# ---- conversations ----

CHAT = """
turns AS (SELECT conv_id, turn, role, text,
   coalesce(max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id), '') AS input,
   lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
   lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output FROM conversations),
fx_chat AS (SELECT conv_id, turn, text AS instruction, input, output FROM turns
   WHERE role = 'user' AND next_role = 'assistant')"""
S, E = fixed.TURN_START, fixed.TURN_END
ECHO_FAILS = "contains(substring(instruction, 1, 40), ':')"


def accuracy(shift: int) -> str:
    return f"""SELECT sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total,
      round(sum(correct)::DOUBLE / sum(total)::DOUBLE, 6) AS accuracy, {shift} AS shift FROM (
      SELECT len(list_filter(range(1, (n - {shift} + 1)::BIGINT), lambda i: labels[i + {shift}] <> -100)) AS total,
             len(list_filter(range(1, (n - {shift} + 1)::BIGINT), lambda i: labels[i + {shift}] <> -100 AND preds[i] = labels[i + {shift}])) AS correct
      FROM tokens)"""


TOKENS = f"""
w AS (SELECT {word_list('text')} AS words FROM conversations),
tokens AS (SELECT len(words) AS n,
   list_transform(words, lambda x, i: CASE WHEN (i - 1) % 4 = 3 THEN -100 ELSE length(x) END) AS labels,
   list_transform(words, lambda x, i: length(x) + CASE WHEN (i - 1) % 7 = 6 THEN 1 ELSE 0 END) AS preds FROM w)"""

# ---- verdicts ----


def points_json(a: str, d: str, e: str) -> str:
    return f"""'{{"Accuracy": ' || ({a}) || ', "Difficulty_Match": ' || ({d}) || ', "Educational_Value": ' || ({e}) || '}}'"""


FIRST_JSON = points_json("quality * 2 + 2", "3 - toxic", "doc_id % 6")
SECOND_JSON = points_json("quality + 3", "4 - toxic * 2", "doc_id % 4")


def reply(first: str) -> str:
    return f"""'{{"SFT_Model": ' || {first} || ', "DPO_Model": ' || {SECOND_JSON} || ', "Summary": "done"}}'"""


def total(model: str) -> str:
    parts = " + ".join(
        f"json_extract(j, '$.{model}.{c}')::DOUBLE" for c in ("Accuracy", "Difficulty_Match", "Educational_Value")
    )
    return f"CASE WHEN json_type(j, '$.{model}') = 'OBJECT' THEN {parts} END"


VERDICTS = f"""
replies AS (SELECT doc_id AS id, toxic, CASE doc_id % 5 WHEN 0 THEN {reply(FIRST_JSON)}
    WHEN 1 THEN '```json' || chr(10) || {reply(FIRST_JSON)} || chr(10) || '```'
    WHEN 2 THEN 'The first answer is better: ' || {FIRST_JSON}
    WHEN 3 THEN '{{"DPO_Model": ' || {SECOND_JSON} || ', "Summary": "one side"}}'
    ELSE {reply("'" + '"not rated"' + "'")} END AS verdict FROM labels),
bare AS (SELECT *, CASE WHEN starts_with(verdict, '```json')
    THEN {stripped("trim(trim(" + stripped('verdict') + ", '`json'), '`')")} ELSE verdict END AS body FROM replies),
checked AS (SELECT *, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body END AS j FROM bare),
judged AS (SELECT id, toxic, valid, j, {total('SFT_Model')} AS first_total, {total('DPO_Model')} AS second_total,
    json_extract_string(j, '$.Summary') AS summary FROM checked)"""

# ---- tutor ----

REQUESTS = """
r AS (SELECT event_id AS request_id, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN 'material'
   WHEN 'purchase' THEN 'assess' WHEN 'click' THEN 'explain' ELSE 'unknown' END AS command, event_type, props,
   CASE WHEN value >= 15 THEN props ELSE '' END AS confusion_point,
   CASE WHEN value < 10 THEN 'beginner' WHEN value < 20 THEN 'intermediate' WHEN value < 30 THEN 'advanced'
        WHEN value < 40 THEN 'expert' END AS current_level FROM events),
r2 AS (SELECT *, coalesce(current_level, 'beginner') AS level,
   CASE coalesce(current_level, 'beginner') WHEN 'beginner' THEN 'easy' WHEN 'advanced' THEN 'hard' ELSE 'medium' END AS difficulty FROM r)"""
DOUBT = f"CASE WHEN confusion_point <> '' THEN {filled(wording.TUTOR_CONFUSION, confusion_point='confusion_point')} ELSE '' END"
TUTOR_SLOTS = {
    "subject": "event_type", "target": "props", "time_available": "'4 weeks'", "topic": "props", "question": "props",
    "student_answer": "event_type", "reference_answer": "props", "concept": "event_type",
    "current_level": "level", "difficulty": "difficulty", "confusion": DOUBT,
}


def by_command(values: dict[str, str]) -> str:
    return "CASE command " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in values.items()) + " END"


AGENT = by_command({k: q(a) for k, (a, _) in fixed.AGENTS.items()})
GRADED = "SELECT user_id AS student_id, event_id, event_type AS topic, value >= 30 AS good, value < 5 AS bad FROM events"
PROFILES = f"""SELECT student_id, 0::BIGINT AS part, arg_max(topic, event_id) AS current_topic,
   coalesce(string_agg(topic, ',' ORDER BY event_id) FILTER (WHERE good), '') AS mastered_topics,
   coalesce(string_agg(topic, ',' ORDER BY event_id) FILTER (WHERE bad), '') AS weak_topics
   FROM ({GRADED}) GROUP BY 1"""

PROFILE_PARTS = f"""WITH g AS ({GRADED}),
   e AS (SELECT *, (row_number() OVER (PARTITION BY student_id ORDER BY event_id) - 1) // {PART} AS part FROM g WHERE good OR bad),
   c AS (SELECT student_id, arg_max(topic, event_id) AS current_topic FROM g GROUP BY 1),
   p AS (SELECT student_id, part, coalesce(string_agg(topic, ',' ORDER BY event_id) FILTER (WHERE good), '') AS mastered_topics,
      coalesce(string_agg(topic, ',' ORDER BY event_id) FILTER (WHERE bad), '') AS weak_topics FROM e GROUP BY 1, 2)
   SELECT student_id, coalesce(part, 0)::BIGINT AS part, current_topic, coalesce(mastered_topics, '') AS mastered_topics,
      coalesce(weak_topics, '') AS weak_topics FROM c LEFT JOIN p USING (student_id)"""

PROGRESS = f"""SELECT student_id, arg_max(topic, event_id) AS current_topic, count(*) FILTER (WHERE good) AS n_mastered,
   count(*) FILTER (WHERE bad) AS n_weak FROM ({GRADED}) GROUP BY 1"""

VOCABULARY = (fixed.TECHNICAL_TERMS, fixed.QUALITY_INDICATORS)
SCORE_PARTS = with_(SCORED, f"SELECT pair_id, sft_ok, preference_ok, {SCORE_COLUMNS} FROM scored")

SAME_STRATUM = "{0}.topic IS NOT DISTINCT FROM {1}.topic AND {0}.difficulty IS NOT DISTINCT FROM {1}.difficulty"


def quotas(n: str) -> str:
    """``n`` divided over the strata of ``sizes`` by largest remainder."""
    return f"""
whole AS (SELECT total, CAST({n} AS BIGINT) AS n FROM (SELECT CAST(sum(size) AS BIGINT) AS total FROM sizes)),
quotas AS (
  SELECT topic, difficulty, size, (n * size) // total + CASE WHEN place <= n - sum((n * size) // total) OVER () THEN 1 ELSE 0 END AS quota
  FROM (SELECT *, row_number() OVER (ORDER BY (n * size) % total DESC, size DESC, topic NULLS FIRST, difficulty NULLS FIRST) AS place
        FROM sizes, whole))"""


ORACLES: dict[str, str] = {
    "curated_topk": with_(SCORED, f"SELECT {FLAT} FROM topk"),
    "curated_topk_gated": with_(
        SCORED,
        f"SELECT {FLAT} FROM (SELECT * FROM scored WHERE sft_ok AND preference_ok ORDER BY score DESC, pair_id LIMIT {TOP})",
    ),
    "topk_per_topic": with_(
        SCORED,
        f"""SELECT * FROM (SELECT pair_id, round(score, 6) AS score,
            row_number() OVER (PARTITION BY topic ORDER BY score DESC, pair_id) AS rank FROM scored) WHERE rank <= {TOP_PER_TOPIC}""",
    ),
    "topk_per_topic_sorted": with_(
        SCORED,
        f"""SELECT * FROM (SELECT pair_id, round(score, 6) AS score,
            row_number() OVER (PARTITION BY topic ORDER BY score DESC, pair_id) AS rank FROM scored) WHERE rank <= {TOP_PER_TOPIC}""",
    ),
    "ranked_pairs": with_(
        SCORED, "SELECT pair_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, pair_id) AS rank FROM scored"
    ),
    "quota_topk": with_(
        SCORED
        + f""",
sizes AS (SELECT topic, difficulty, count(*) AS size FROM scored GROUP BY ALL),
{quotas(f"least({TOP}, total)")},
placed AS (SELECT *, row_number() OVER (PARTITION BY topic, difficulty ORDER BY score DESC, pair_id) AS place FROM scored)""",
        f"""SELECT {FLAT} FROM (SELECT placed.* FROM placed JOIN quotas q ON {SAME_STRATUM.format("placed", "q")} WHERE place <= quota)""",
    ),
    "score_parts": SCORE_PARTS,
    "score_parts_default": SCORE_PARTS.replace(COVERED, covered(fixed.CATEGORIES.values())),
    "curated_topk_sorted": with_(SCORED, "SELECT pair_id, round(score, 6) AS score FROM topk"),
    "curated_per_topic": with_(
        SCORED,
        f"""SELECT {FLAT} FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, pair_id) AS rank FROM scored)
        WHERE rank <= {TOP_PER_TOPIC}""",
    ),
    "stream_scores": SCORE_PARTS,
    "stream_joined_scores": with_(
        SCORED + ", toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)",
        "SELECT pair_id, pair_id NOT IN (FROM toxic) AS matched, sft_ok, CASE WHEN pair_id NOT IN (FROM toxic) THEN preference_ok END AS preference_ok, "
        + ", ".join(f"CASE WHEN pair_id NOT IN (FROM toxic) THEN round({c}, 6) END AS {c}" for c in ("quality", "relevance", "diversity", "difficulty_score", "score"))
        + " FROM scored",
    ),
    "gate_flags": with_(SCORED, "SELECT pair_id AS sft_index, sft_ok, preference_ok FROM scored"),
    "unzipped_sides": with_(
        SCORED,
        "SELECT side, count(*) AS n, sum(pair_id)::BIGINT AS keys FROM topk, (VALUES ('sft'), ('preference')) v(side) GROUP BY 1",
    ),
    "unpaired_left": with_(
        FX, "SELECT sft_index, topic, difficulty FROM fx_sft WHERE sft_index NOT IN (SELECT doc_id FROM labels)"
    ),
    "positional_pairs": """SELECT pos AS pair_id, doc_id, label_id FROM
        (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents)
        JOIN (SELECT doc_id AS label_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM labels) USING (pos)""",
    "first_rows": f"SELECT * FROM labels ORDER BY doc_id LIMIT {TOP_PER_TOPIC}",
    "resume_hwm": """WITH mark AS (
          SELECT max(doc_id) AS top FROM labels WHERE quality = 1 AND doc_id <= (SELECT floor(avg(doc_id)) FROM labels)),
        pending AS (SELECT doc_id AS sft_index, lang FROM documents, mark WHERE doc_id > top)
        SELECT *, 'all' AS mode FROM pending
        UNION ALL SELECT *, 'below' FROM pending WHERE sft_index < (SELECT floor(max(doc_id) * 0.9) FROM documents)""",
    "resume_by_key": "SELECT doc_id AS sft_index, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "resume_fresh_ids": """SELECT unnest(range((SELECT max(doc_id) + 1 FROM labels), (SELECT max(doc_id) + 1 FROM labels)
        + greatest((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels), 0))) AS sft_index""",
    "extended_rows": """SELECT lang, CASE WHEN l.doc_id IS NOT NULL THEN 'done' END AS state, count(*) AS n,
        sum(d.doc_id)::BIGINT AS keys FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2""",
    "jsonl_round_trip": with_(
        FX,
        r"""SELECT sft_index, instruction, input, output, true AS parsed FROM fx_sft UNION ALL
        SELECT NULL, regexp_replace(text, '[\r\n]+', ' ', 'g'), NULL, NULL, false FROM conversations WHERE regexp_matches(text, '[^""" + SPACE + r"""]')""",
    ),
    "json_array_round_trip": with_(FX, "SELECT sft_index, instruction, input, output FROM fx_sft"),
    "continued_write": "SELECT doc_id AS sft_index, lang, source FROM documents",
    "split_failures": with_(
        FX, f"SELECT sft_index, CASE WHEN {visible('output')} THEN 'ok' ELSE 'failed' END AS state FROM fx_sft"
    ),
    "length_profile": with_(
        FX,
        profile("sft", "length(instruction || ' ' || input || ' ' || output)", "fx_sft")
        + " UNION ALL " + profile("preference", "length(prompt || ' ' || chosen || ' ' || rejected)", "fx_pref"),
    ),
    "topic_distribution": distribution("SELECT sft_index, coalesce(topic, 'Unknown') AS x FROM fx_sft", "x"),
    "difficulty_distribution": distribution("SELECT sft_index, coalesce(difficulty, 'medium') AS x FROM fx_sft", "x"),
    "strategy_distribution": distribution(f"SELECT sft_index, {STRATEGY} AS x FROM fx_sft", "x"),
    "frequent_words": f"""WITH w AS (SELECT unnest({word_list('lower(text)')}) AS value FROM documents),
        c AS (SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) AS place FROM w GROUP BY value)
        SELECT value, n, coalesce((SELECT n FROM c WHERE place = 11), 0) AS next_n FROM c WHERE place <= 10""",
    "json_array_any_layout": with_(FX, "SELECT sft_index, instruction, input, output FROM fx_sft"),
    "finished_runs": """SELECT doc_id AS sft_index, lang, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS run_id FROM documents""",
    "near_vectors": """WITH RECURSIVE every AS (
          SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          UNION ALL SELECT -1 - vec_id, list_transform(embedding, lambda x: CASE WHEN x = list_max(embedding) THEN 0 ELSE x END)::DOUBLE[] FROM embeddings),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM every a, every b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(vec_id, r) AS (SELECT vec_id, vec_id FROM every UNION SELECT reach.vec_id, y FROM reach JOIN link ON r = x),
        copies AS (SELECT e, count(*) AS n_copies FROM every GROUP BY e)
        SELECT vec_id, min(r) AS group_id, any_value(n_copies) AS n_copies FROM reach JOIN every USING (vec_id) JOIN copies USING (e) GROUP BY vec_id""",
    "criteria_frequency": distribution(f"SELECT unnest({CRITERIA}) AS x FROM fx_sft", "x", key=None),
    "diff_stats": with_(
        FX,
        """SELECT 'quality_difference' AS name, count(*) AS n, round(avg(quality_difference), 6) AS avg,
        round(stddev_pop(quality_difference), 6) AS std, round(min(quality_difference), 6) AS min,
        round(max(quality_difference), 6) AS max FROM fx_pref""",
    ),
    "diff_histogram": with_(
        FX,
        f"""SELECT bucket, count(d) AS n, round(count(d) * 100.0 / (SELECT count(*) FROM fx_pref), 6) AS pct
        FROM (VALUES ('< 0.3'), ('0.3 - 0.6'), ('>= 0.6')) b(bucket) LEFT JOIN
        (SELECT quality_difference AS d, CASE WHEN d < {num(.3)} THEN '< 0.3' WHEN d < {num(.6)} THEN '0.3 - 0.6' ELSE '>= 0.6' END AS bucket
         FROM fx_pref) USING (bucket) GROUP BY 1""",
    ),
    "input_share": with_(
        FX, f"SELECT count(*) FILTER (WHERE {visible('input')}) AS n, round(count(*) FILTER (WHERE {visible('input')}) * 100.0 / count(*), 6) AS pct FROM fx_sft"
    ),
    "field_lengths": with_(
        FX,
        " UNION ALL ".join(
            profile(n, x, "fx_sft")
            for n, x in (("instruction", "length(instruction)"), ("output", "length(output)"), ("sft_index", "coalesce(sft_index, -1)"))
        ),
    ),
    "score_profile": with_(
        SCORED,
        """SELECT 'score' AS name, count(*) AS n, round(avg(score), 6) AS avg, round(stddev_pop(score), 6) AS std,
        round(min(score), 6) AS min, round(max(score), 6) AS max FROM topk""",
    ),
    "validation_report": f"""SELECT "check", expected, actual, expected = actual AS ok FROM (
        SELECT 'same_count' AS "check", (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM labels) AS actual UNION ALL
        SELECT 'target_count', {fixed.TARGET_PAIRS}, (SELECT count(*) FROM documents))""",
    "profile_grouping_sets": with_(
        f"""{FX}, v AS (SELECT unnest([{{'d': 'topic', 'v': coalesce(topic, 'Unknown')}},
             {{'d': 'difficulty', 'v': coalesce(difficulty, 'medium')}}, {{'d': 'degradation_strategy', 'v': {STRATEGY}}}]) AS x FROM fx_sft)""",
        """SELECT x.d AS dimension, x.v AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS pct
        FROM v GROUP BY 1, 2""",
    ),
    "template_rows": with_(template_ctes(False), "SELECT * FROM made"),
    "template_rows_literal": with_(template_ctes(True), "SELECT * FROM made"),
    "template_rows_wide": with_(template_ctes(False, PART_TOPICS, "(SELECT count(*) FROM part)"), "SELECT * FROM made"),
    "generated_rows": with_(
        f"""{template_ctes(False)}, asked AS (SELECT *, CASE WHEN {visible('input')}
        THEN {filled(wording.ANSWER_USER_WITH_INPUT, instruction='instruction', input='input')}
        ELSE {filled(wording.ANSWER_USER, instruction='instruction')} END AS request FROM made)""",
        f"""SELECT sft_index, instruction, CASE WHEN contains(substring(request, 1, 40), ':') THEN {FALLBACK_ANSWER}
        ELSE {stripped('request')} END AS output,
        CASE WHEN contains(substring(request, 1, 40), ':') THEN 'ValueError: refused' END AS error FROM asked""",
    ),
    "fallback_answers": with_(template_ctes(False), f"SELECT sft_index, {FALLBACK_ANSWER} AS output FROM made"),
    "answer_prompts": with_(
        template_ctes(False),
        f"""SELECT sft_index, {filled(wording.ANSWER_SYSTEM, level='upper(difficulty)', style=STYLE, **SLOTS)} AS system,
        CASE WHEN {visible('input')} THEN {filled(wording.ANSWER_USER_WITH_INPUT, instruction='instruction', input='input')}
        ELSE {filled(wording.ANSWER_USER, instruction='instruction')} END AS user FROM made""",
    ),
    "responder_echo": with_(
        CHAT,
        f"""SELECT conv_id, turn, CASE WHEN {ECHO_FAILS} THEN {filled(fixed.FALLBACK_RESPONSE, prompt='instruction')}
        ELSE {stripped('instruction')} END AS response, CASE WHEN {ECHO_FAILS} THEN 'ValueError: refused' END AS error FROM fx_chat""",
    ),
    "prompt_concat": with_(FX, f"SELECT sft_index, {PROMPT} AS prompt FROM fx_sft"),
    "chosen_sides": with_(BASE, "SELECT * FROM base"),
    "strategy_round_robin": with_(
        FX,
        f"""SELECT sft_index, strategy, {other('strategy')} AS other, {filled(wording.DEGRADE_SYSTEM, strategy='strategy')} AS system,
        {asked('strategy', 'instruction', "coalesce(topic, 'Unknown')")} AS user
        FROM (SELECT *, {STRATEGY} AS strategy FROM fx_sft)""",
    ),
    "degraded_answers": with_(
        f"{FX}, spared AS (SELECT *, {STRATEGY} AS strategy, {spare_of('output')} AS spare FROM fx_sft)",
        f"SELECT sft_index, strategy, {weakened('output', 'strategy', 'spare')} AS degraded FROM spared",
    ),
    "answer_quality": with_(
        FX,
        f"""SELECT sft_index, round({answer_points('chosen')}, 6) AS chosen_score, round({answer_points('rejected')}, 6) AS rejected_score,
        round(quality_difference, 6) AS quality_difference FROM fx_pref""",
    ),
    "answer_quality_default": with_(
        FX,
        f"""SELECT sft_index, round(a, 6) AS chosen_score, round(b, 6) AS rejected_score, round(greatest(a - b, {num(0.0)}), 6) AS quality_difference
        FROM (SELECT sft_index, {answer_points('chosen', *VOCABULARY)} AS a, {answer_points('rejected', *VOCABULARY)} AS b FROM fx_pref)""",
    ),
    "weak_pairs": with_(
        WEAK, "SELECT weak AS retried, sft_index, degradation_strategy, rejected, round(quality_difference, 6) AS quality_difference FROM kept"
    ),
    "criteria_sample": with_(
        f"{FX}, sampled AS (SELECT sft_index, {CRITERIA} AS names FROM fx_sft)",
        f"SELECT sft_index, array_to_string(names, ', ') AS criteria, {PHRASES} AS phrases, {REASON} AS reason FROM sampled",
    ),
    "preference_rows": with_(
        f"{BY_RULE}, sampled AS (SELECT *, {CRITERIA} AS names FROM kept)",
        f"""SELECT prompt, chosen, rejected, {REASON} AS reason, array_to_string(names, ',') AS criteria_used, topic, difficulty,
        round(quality_difference, 6) AS quality_difference, degradation_strategy, sft_index FROM sampled""",
    ),
    "preference_first_n": with_(
        BY_RULE.replace("FROM cut2)", f"FROM cut2 WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {TOP}))"),
        "SELECT sft_index, prompt, chosen, rejected, degradation_strategy FROM kept",
    ),
    "model_preferences": with_(
        BY_MODEL, "SELECT sft_index, degradation_strategy, rejected, round(quality_difference, 6) AS quality_difference FROM kept"
    ),
    "chat_sft": with_(
        CHAT,
        f"""SELECT conv_id, turn, {q(S + 'user')} || chr(10) || instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END
        || {q(E)} || chr(10) || {q(S + 'assistant')} || chr(10) || output || {q(E)} AS text FROM fx_chat""",
    ),
    "chat_dpo": with_(
        FX,
        f"""SELECT sft_index, {q(S + 'user')} || chr(10) || prompt || {q(E)} || chr(10) || {q(S + 'assistant')} || chr(10) AS prompt,
        chosen, rejected FROM fx_pref WHERE prompt <> '' AND chosen <> '' AND rejected <> ''""",
    ),
    "incomplete_rows": with_(FX, "SELECT sft_index, instruction = '' OR output = '' AS incomplete FROM fx_sft"),
    "split_exact": f"""SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || doc_id))
        <= floor((SELECT count(*) FROM documents) * {fixed.TRAIN_RATIO}) THEN 'train' ELSE 'eval' END AS split FROM documents""",
    "split_grouped": "WITH RECURSIVE "
    + f"""{FX.strip()},
keyed AS (SELECT sft_index, topic, difficulty, ('0x' || substring(md5('{SEED}' || chr(31) || '=' || {PROMPT}), 1, 15))::BIGINT AS g FROM fx_sft),
grouped AS (
  SELECT g, count(*) AS n, first(topic ORDER BY topic NULLS FIRST, difficulty NULLS FIRST) AS topic,
         first(difficulty ORDER BY topic NULLS FIRST, difficulty NULLS FIRST) AS difficulty FROM keyed GROUP BY g),
sizes AS (SELECT topic, difficulty, sum(n)::BIGINT AS size FROM grouped GROUP BY ALL),
{quotas(f"floor(total * {num(fixed.TRAIN_RATIO)})")},
run AS (SELECT g, n, sum(n) OVER (PARTITION BY topic, difficulty ORDER BY g) AS upto, topic, difficulty FROM grouped),
fit AS (
  SELECT q.topic, q.difficulty, quota, coalesce(max(upto) FILTER (upto <= quota), 0) AS taken, max(g) FILTER (upto <= quota) AS cut,
         min(g) FILTER (upto > quota) AS next, arg_min(n, g) FILTER (upto > quota) AS weight
  FROM run JOIN quotas q ON {SAME_STRATUM.format("run", "q")} GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY taken - quota, topic NULLS FIRST, difficulty NULLS FIRST) AS k FROM fit),
given(k, short, topic, difficulty, cut) AS (
  SELECT 0::BIGINT, (SELECT sum(quota - taken) FROM fit), NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT
  UNION ALL
  SELECT p.k, CASE WHEN weight <= short THEN short - weight ELSE short END, p.topic, p.difficulty, CASE WHEN weight <= short THEN next ELSE p.cut END
  FROM given JOIN placed p ON p.k = given.k + 1),
train AS (SELECT r.g FROM run r JOIN given ON given.k > 0 AND {SAME_STRATUM.format("r", "given")} WHERE r.g <= given.cut)
SELECT sft_index, CASE WHEN g IN (SELECT g FROM train) THEN 'train' ELSE 'eval' END AS split FROM keyed""",
    "split_bucket": f"""SELECT doc_id, lang, CASE WHEN ('0x' || substring(md5('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE
        < {num(fixed.TRAIN_RATIO)} THEN 'train' ELSE 'eval' END AS split FROM documents""",
    "token_budget": with_(
        f"w AS (SELECT doc_id, {word_list('text')} AS words FROM documents)",
        f"""SELECT doc_id, array_to_string(list_slice(words, 1, {fixed.TOKEN_BUDGET}), ' ') AS tokens,
        least(len(words), {fixed.TOKEN_BUDGET})::INT AS n_labels, len(words) > {fixed.TOKEN_BUDGET} AS truncated FROM w""",
    ),
    "truncation_share": with_(
        f"w AS (SELECT len({word_list('text')}) AS n_words FROM documents)",
        f"""SELECT count(*) AS n, count(*) FILTER (WHERE n_words > {fixed.TOKEN_BUDGET}) AS n_truncated,
        round(avg(least(n_words, {fixed.TOKEN_BUDGET})), 6) AS avg_tokens FROM w""",
    ),
    "masked_accuracy": with_(TOKENS, f"{accuracy(0)} UNION ALL {accuracy(1)}"),
    "argmax_labels": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings",
    "judge_totals": with_(VERDICTS, "SELECT id, valid, first_total, second_total, summary FROM judged"),
    "judge_summary": with_(
        f"""{VERDICTS}, cells AS (SELECT m.model, c.criterion,
             CASE WHEN json_type(j, '$.' || m.model) = 'OBJECT' THEN json_extract(j, '$.' || m.model || '.' || c.criterion)::DOUBLE END AS points
             FROM judged, (VALUES ('SFT_Model'), ('DPO_Model')) m(model),
             (VALUES ('Accuracy'), ('Difficulty_Match'), ('Educational_Value')) c(criterion))""",
        "SELECT model, criterion, count(points) AS n, round(avg(points), 6) AS mean_points FROM cells WHERE points IS NOT NULL GROUP BY 1, 2",
    ),
    "judge_outcomes": with_(
        VERDICTS,
        """SELECT count(*) FILTER (WHERE second_total > first_total) AS wins, count(*) FILTER (WHERE second_total = first_total) AS ties,
        count(*) FILTER (WHERE second_total < first_total) AS losses,
        count(*) FILTER (WHERE first_total IS NULL OR second_total IS NULL) AS not_comparable FROM judged""",
    ),
    "judge_intervals": with_(
        f"""{VERDICTS},
both_totals AS (SELECT id, second_total - first_total AS gap, CASE WHEN second_total > first_total THEN 1.0 WHEN second_total = first_total THEN 0.5 ELSE 0.0 END::DOUBLE AS win
  FROM judged WHERE first_total IS NOT NULL AND second_total IS NOT NULL),
drawn AS (SELECT s, gap, win, ('0x' || substring(md5('{SEED}:' || id || ':' || (s // 4)), CAST((s % 4) * 8 + 1 AS BIGINT), 8))::BIGINT AS u FROM both_totals, range(200) r(s)),
steps AS (SELECT k, round(sum(exp(-1) / factorial(k::INT)) OVER (ORDER BY k) * 4294967296) AS step FROM range(14) r(k)),
weighted AS (SELECT s, gap, win, u, (SELECT count(*) FROM steps WHERE step < 4294967296 AND step <= u) AS w FROM drawn),
samples AS (SELECT s, sum(w * gap) / sum(w) AS mean_difference, sum(w * win) / sum(w) AS win_rate FROM weighted WHERE w > 0 GROUP BY s),
whole AS (SELECT count(*) AS n, avg(gap) AS gap, avg(win) AS win FROM both_totals)""",
        """SELECT 'mean_difference' AS measure, any_value(n) AS n, round(any_value(gap), 6) AS estimate,
        round(quantile_cont(mean_difference, 0.025), 6) AS lower, round(quantile_cont(mean_difference, 0.975), 6) AS upper FROM samples, whole
        UNION ALL SELECT 'win_rate', any_value(n), round(any_value(win), 6), round(quantile_cont(win_rate, 0.025), 6), round(quantile_cont(win_rate, 0.975), 6) FROM samples, whole""",
    ),
    "judge_prompts": with_(
        FX, f"SELECT sft_index, {filled(wording.JUDGE, prompt='prompt', first='chosen', second='rejected')} AS judge_prompt FROM fx_pref"
    ),
    "eval_results": with_(
        f"{FX}, {VERDICTS.strip()}, results AS (SELECT s.*, j.*, j.id IS NULL OR j.toxic = 1 AS failed FROM fx_sft s LEFT JOIN judged j ON s.sft_index = j.id)",
        f"""SELECT sft_index AS id, instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END AS prompt,
        CASE WHEN failed THEN {q(fixed.FAILED_ANSWER)} ELSE 'first' END AS sft_response,
        CASE WHEN failed THEN {q(fixed.FAILED_ANSWER)} ELSE 'second' END AS dpo_response,
        CASE WHEN failed THEN {q(fixed.FAILED_VERDICT)} WHEN NOT valid THEN 'invalid verdict' END AS error,
        CASE WHEN NOT failed THEN first_total END AS sft_total, CASE WHEN NOT failed THEN second_total END AS dpo_total FROM results""",
    ),
    "inference_prompts": with_(
        FX,
        f"""SELECT sft_index, {q(S + 'user')} || chr(10) || instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END
        || {q(E)} || chr(10) || {q(S + 'assistant')} || chr(10) AS prompt FROM fx_sft""",
    ),
    "eval_size_check": f"""SELECT 'minimum_rows' AS "check", {fixed.MIN_EVAL_ROWS}::BIGINT AS expected, count(*) AS actual,
        count(*) >= {fixed.MIN_EVAL_ROWS} AS ok FROM benchmark""",
    "request_prompts": with_(
        REQUESTS,
        f"""SELECT request_id, command, {AGENT} AS agent,
        ({by_command({k: str(t) for k, (_, t) in fixed.AGENTS.items()})})::DOUBLE AS temperature,
        {by_command({k: q(t) for k, t in wording.TUTOR_SYSTEM.items()})} AS system,
        {by_command({k: filled(t, **TUTOR_SLOTS) for k, t in wording.TUTOR_USER.items()})} AS user FROM r2""",
    ),
    "level_difficulty": with_(REQUESTS, "SELECT current_level, difficulty, count(*) AS n FROM r2 GROUP BY 1, 2"),
    "assessment_outcome": f"SELECT event_id, CASE WHEN good THEN 'mastered' WHEN bad THEN 'weak' END AS outcome FROM ({GRADED})",
    "error_answers": with_(
        REQUESTS, f"SELECT request_id, 'Error in ' || coalesce({AGENT}, '') || ': ' || props AS answer FROM r2"
    ),
    "tutor_answers": with_(
        REQUESTS,
        f"""SELECT request_id, ({by_command({k: q(f'{t:.1f} ') for k, (_, t) in fixed.AGENTS.items()})})
        || {stripped(by_command({k: filled(t, **TUTOR_SLOTS) for k, t in wording.TUTOR_USER.items()}))} AS response,
        NULL::VARCHAR AS error FROM r2""",
    ),
    "student_profiles": PROFILES,
    "stream_lists": PROFILES,
    "student_profiles_parts": PROFILE_PARTS,
    "stream_profiles": PROFILES,
    "student_progress": PROGRESS,
    "stream_progress": PROGRESS,
}
