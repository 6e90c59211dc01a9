"""Default wording of the requests sent to a model. Every operator takes its own."""

STYLES = {
    "easy": "plain words, short sentences, no prior knowledge assumed",
    "medium": "correct terminology with worked detail",
    "hard": "rigorous, at the level of a research seminar",
}

ANSWER_SYSTEM = (
    "You teach {topic}. Answer the request accurately and in good order.\n"
    "Level: {level}\nStyle: {style}\nConcept: {concept}"
)
ANSWER_USER = "Request: {instruction}\nAnswer in full:"
ANSWER_USER_WITH_INPUT = "Request: {instruction}\nMaterial: {input}\nAnswer in full:"

DEGRADE_SYSTEM = "Write a deliberately weak answer of this kind: {strategy}."
DEGRADE_USER = {
    "oversimplify": "Answer in one shallow sentence without any technical detail.\n\nQuestion: {prompt}",
    "add_errors": "Answer with wrong facts and mixed-up notions of {topic}.\n\nQuestion: {prompt}",
    "make_vague": "Answer with hedges only, never with anything specific.\n\nQuestion: {prompt}",
    "add_irrelevant": "Begin on the subject, then drift to unrelated matters.\n\nQuestion: {prompt}",
    "disorganize": "Answer in a jumbled order that is hard to follow.\n\nQuestion: {prompt}",
    "incomplete": "Answer only a part and leave the main points out.\n\nQuestion: {prompt}",
}
HEDGE = "It may depend, but broadly speaking: "

# {phrases}: phrases joined by " and "; {names}: names joined by ", ";
# {first}, {second}: the first two names.
REASONS = (
    "The chosen answer is {phrases} and therefore teaches more.",
    "Judged by {names}, the chosen answer is the better one.",
    "The rejected answer falls short in {first} and {second}.",
    "The two answers differ in {names}; the chosen one leads.",
)

JUDGE = (
    "Compare two answers to one request. Give each answer whole points from 0 to 5 for "
    "Accuracy, Difficulty_Match and Educational_Value.\n\n"
    "Request: {prompt}\n\nSFT_Model: {first}\n\nDPO_Model: {second}\n\n"
    "Reply with JSON only: {\"SFT_Model\": {\"Accuracy\": n, \"Difficulty_Match\": n, "
    "\"Educational_Value\": n}, \"DPO_Model\": {same keys}, \"Summary\": \"one sentence\"}"
)

TUTOR_SYSTEM = {
    "plan": "You plan courses of study that fit the learner's level, goal and time.",
    "material": "You write accurate learning material with exercises.",
    "assess": "You grade answers strictly and fairly and explain each deduction.",
    "explain": "You explain hard notions through analogies, fitted to the learner.",
}
TUTOR_USER = {
    "plan": "Plan the study of {subject}. Level: {current_level}. Goal: {target}. "
            "Time: {time_available}. List phases, weekly work, checks and resources.",
    "material": "Write material on \"{topic}\" in {subject}, difficulty {difficulty}: "
                "core notions, key points, a use case and three solved exercises.",
    "assess": "Grade this answer in {subject}.\nQuestion: {question}\nAnswer: {student_answer}\n"
              "Model answer: {reference_answer}\nGive points from 1 to 10, errors and advice.",
    "explain": "Explain \"{concept}\" to a learner at level {current_level}.{confusion} "
               "Use an everyday analogy and clear up likely mistakes.",
}
TUTOR_CONFUSION = " The learner is unsure about: {confusion_point}."
