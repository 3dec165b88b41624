"""The prompt catalog. Names, slots and roles are the interface; the wording is this package's own.

A template is (category, name, prompt, examples, multi_input). ``{INPUT_0}``, ``{INPUT_1}``, ... are the
slots, an example is (inputs, answer). With ``multi_input`` the prompt sees the whole row, otherwise
only the input that is being changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T

SYSTEM_LINE = "You are a helpful assistant."
ONLY_TEXT = "Reply with the new text only."
TRUE_FALSE = "Reply with 'true' or 'false' only."


@dataclass(frozen=True)
class Template:
    category: str
    name: str
    prompt: str
    examples: tuple[tuple[tuple[str, ...], str], ...] = ()
    multi_input: bool = False

    @property
    def key(self) -> str:
        return f"{self.category}:{self.name}"


def _rewrite(name: str, order: str, before: str, after: str) -> Template:
    return Template("it_prompt", name, f'{order}\n"{{INPUT_0}}"\n{ONLY_TEXT}', (((before,), after),))


SUT_PROMPTS = (
    Template("sut_prompt", "key_idea", 'State the main point of this sentence briefly:\n"{INPUT_0}"'),
    Template(
        "sut_prompt",
        "question_answering",
        'Information:\n"{INPUT_0}"\nUse nothing but this information to answer:\n"{INPUT_1}"\n'
        "Answer in one short sentence, or 'unknown' if the information does not say.",
    ),
    Template(
        "sut_prompt",
        "boolean_question_answering",
        'Information:\n"{INPUT_0}"\nUse nothing but this information to answer:\n"{INPUT_1}"\nReply yes, no or unknown.',
    ),
    Template(
        "sut_prompt",
        "inference",
        'First: "{INPUT_0}"\nSecond: "{INPUT_1}"\nDoes the first lead to the second? '
        "Reply with one word: entailment, contradiction or neutral.",
    ),
    Template(
        "sut_prompt",
        "semantic_similarity",
        'First: "{INPUT_0}"\nSecond: "{INPUT_1}"\nRate how alike they are, 0 (not at all) to 1 (same). Number only.',
    ),
    Template(
        "sut_prompt", "sentiment_analysis", 'Is this text positive, negative or neutral? One word.\n"{INPUT_0}"'
    ),
    Template(
        "sut_prompt",
        "sentiment_analysis_continuous",
        'Rate the sentiment of this text, 0 (negative) to 1 (positive).\n"{INPUT_0}"\nReply with a single number.',
    ),
    Template("sut_prompt", "fake_news", 'Is this news made up? Reply yes or no.\n"{INPUT_0}"'),
    Template("sut_prompt", "named_entity_recognition", 'List the named entities and their types.\n"{INPUT_0}"'),
    Template("sut_prompt", "coreference_resolution", 'List the phrases that mean the same thing.\n"{INPUT_0}"'),
    Template(
        "sut_prompt",
        "relation_extraction",
        'Text: "{INPUT_0}"\nName the relation from "{INPUT_1}" to "{INPUT_2}" that the text states, as briefly as '
        "possible. Reply 'no relation' if there is none or a word is missing from the text.",
    ),
    Template("sut_prompt", "part_of_speech_tagging", 'List each word with its part of speech.\n"{INPUT_0}"'),
    Template(
        "sut_prompt",
        "stance_detection",
        'First: "{INPUT_0}"\nSecond: "{INPUT_1}"\nDoes the first agree, disagree or stay neutral? One word.',
    ),
)

REWRITE_PROMPTS = (
    _rewrite("synonym_replacement", "Put synonyms in, keep the meaning:", "We started early.", "We began early."),
    _rewrite("negate", "Negate this, changing little:", "The train left.", "The train did not leave."),
    _rewrite("negate1", "Turn the meaning around, changing little:", "I like tea.", "I dislike tea."),
    _rewrite("antonym_replacement", "Put antonyms in, change the meaning:", "The door is open.", "The door is shut."),
    _rewrite("paraphrasing", "Say this in other words:", "It rained all day.", "All day long it rained."),
    _rewrite("misspell", "Add spelling errors:", "The garden is green.", "Teh gardn is grene."),
    _rewrite("adverbial_position", "Move the adverbial clause:", "When it rains, we read.", "We read when it rains."),
    _rewrite("abbreviation_replacement", "Swap short and long forms:", "I can't come.", "I cannot come."),
    _rewrite("word_insertion", "Add random words, change none:", "He sat down.", "He sat blue down."),
    _rewrite("word_category_replacement", "Swap names and the like for others:", "Ann is Dutch.", "Bob is Greek."),
    _rewrite("number_replacement", "Change every number:", "It weighs 3 kg.", "It weighs 7 kg."),
    _rewrite("singular_plural", "Swap singular and plural:", "A bird sings.", "Birds sing."),
    _rewrite("tense_change", "Change the tense, or copy the text:", "She walks.", "She walked."),
    _rewrite("joining_word_swap", "Swap what a joining word joins:", "Salt and pepper.", "Pepper and salt."),
    _rewrite("comparative_swap", "Swap the comparison, keep the meaning:", "A is over B.", "B is under A."),
    _rewrite("comparative_swap_invert", "Swap the comparison, turn the meaning:", "A is over B.", "B is over A."),
    _rewrite("comparative_invert", "Turn the comparison around:", "A is over B.", "A is under B."),
    _rewrite("passive_active", "Swap active and passive voice:", "Tom baked it.", "It was baked by Tom."),
    _rewrite("emphasis_words", "Strengthen this with emphasis words:", "It was good.", "It was really good."),
    _rewrite("capitalize_words", "Put important words in CAPITALS:", "It was good.", "It was GOOD."),
    _rewrite("declarative_interrogative", "Swap statement and question:", "It is late.", "Is it late?"),
    _rewrite("remove_keywords", "Find the keywords and take them out:", "The cat sleeps.", "The."),
    _rewrite("replace_keywords", "Find the keywords and put unrelated text in:", "The cat sleeps.", "The lid melts."),
    _rewrite("superset_word", "Give a broader term:", "rose", "flower"),
    Template(
        "it_prompt",
        "identify_coreferential_word",
        'Text:\n"{INPUT_0}"\nGive one phrase of the text that means the same as "{INPUT_1}", or none.',
        ((("Eve said she was late.", "Eve", ""), "she"),),
        True,
    ),
    Template(
        "it_prompt",
        "identify_symmetric_word",
        'Text:\n"{INPUT_0}"\nGive one phrase of the text that could stand in for "{INPUT_1}", or none.',
        ((("Ann met Bob and Cid.", "Bob", ""), "Cid"),),
        True,
    ),
    Template(
        "it_prompt", "generate_symmetric_word", 'Give a word in a symmetric relation to "{INPUT_0}".', ((("aunt",), "uncle"),), True
    ),
    Template(
        "it_prompt",
        "generate_premesis_from_hypothesis",
        f'Write a premise that leads to:\n"{{INPUT_1}}"\n{ONLY_TEXT}',
        ((("", "He is wet."), "He stood in the rain."),),
        True,
    ),
    Template(
        "it_prompt",
        "generate_premesis_from_premesis",
        f'Write a premise that leads to:\n"{{INPUT_0}}"\n{ONLY_TEXT}',
        ((("He is wet.", ""), "He stood in the rain."),),
        True,
    ),
    Template(
        "it_prompt",
        "generate_hypothesis_from_premesis",
        f'Write a hypothesis that follows from:\n"{{INPUT_0}}"\n{ONLY_TEXT}',
        ((("He stood in the rain.", ""), "He is wet."),),
        True,
    ),
    Template(
        "it_prompt",
        "generate_hypothesis_from_hypothesis",
        f'Write a hypothesis that follows from:\n"{{INPUT_1}}"\n{ONLY_TEXT}',
        ((("", "He stood in the rain."), "He is wet."),),
        True,
    ),
)

RELATION_PROMPTS = (
    Template(
        "or_prompt",
        "re_opposite_relation",
        f'Relation 1: "{{INPUT_0}}"\nRelation 2: "{{INPUT_1}}"\nAre they opposites? {TRUE_FALSE}',
        ((("teacher of", "pupil of"), "true"), (("lives in", "owns"), "false")),
    ),
)

VERIFIER_PROMPTS = tuple(
    Template("verify_prompt", name, f'{question}\n"{{INPUT_0}}"\n{TRUE_FALSE}', (((yes,), "true"), ((no,), "false")))
    for name, question, yes, no in (
        ("adverbial_clause", "Is there an adverbial clause in this?", "When it rains, we read.", "We read."),
        ("joining_phrase", "Is there a joining phrase in this?", "Salt and pepper.", "Salt."),
        ("comparative_statement", "Is there a comparison in this?", "A is over B.", "A is here."),
        ("re_symmetry", "Does this relation hold both ways?", "married to", "owns"),
        ("re_asymmetry", "Does this relation hold one way only?", "owns", "married to"),
    )
)

# Prompts that keyword edits, negation and answer checks use by themselves.
HELPER_PROMPTS = (
    Template(
        "helper",
        "keywords",
        'List the names, pronouns, countries, jobs and similar words of this text, one per line:\n"{INPUT_0}"',
        ((("Ann from Peru teaches.",), "Ann\nPeru"),),
    ),
    Template(
        "helper",
        "entity_keywords",
        'Text:\n"{INPUT_0}"\nList the names, jobs and similar words tied to "{INPUT_1}" and "{INPUT_2}", one per line.',
        ((("Ann from Peru teaches Bob.", "Ann", "Bob"), "Peru\nteaches"),),
    ),
    Template("helper", "category_word", 'Name something of the same kind as "{INPUT_0}".', ((("Ann",), "Bob"),)),
    Template(
        "helper",
        "synonym_word",
        'Context:\n"{INPUT_0}"\nGive a synonym of "{INPUT_1}" that fits, or the word itself.',
        ((("We started early.", "started"), "began"),),
    ),
    Template(
        "helper",
        "antonym_word",
        'Context:\n"{INPUT_0}"\nGive an antonym of "{INPUT_1}" that fits, or the word itself.',
        ((("The door is open.", "open"), "shut"),),
    ),
    Template(
        "helper",
        "apply_rules",
        f'Text:\n"{{INPUT_0}}"\nReplace words by these rules; skip rules that do not apply:\n{{INPUT_1}}\n{ONLY_TEXT}',
        ((("Ann is here.", "ann -> bob\nsun -> moon"), "Bob is here."),),
    ),
    Template(
        "helper",
        "remove_words",
        f'Text:\n"{{INPUT_0}}"\nTake these words out:\n{{INPUT_1}}\n{ONLY_TEXT}',
        ((("Ann is here.", "ann"), "is here."),),
    ),
    Template(
        "helper",
        "negate_text",
        f'Negate this, changing little:\n"{{INPUT_0}}"\n{ONLY_TEXT}',
        ((("The train left.",), "The train did not leave."),),
    ),
    Template(
        "helper",
        "negate_context",
        f'Question:\n"{{INPUT_1}}"\nNegate what bears on the question in this text:\n"{{INPUT_0}}"\n{ONLY_TEXT}',
        ((("Ann ran home.", "Who ran?"), "Ann did not run home."),),
    ),
    Template(
        "helper",
        "negate_relation",
        f'Negate this text so that the relation from "{{INPUT_1}}" to "{{INPUT_2}}" turns around:\n"{{INPUT_0}}"\n{ONLY_TEXT}',
        ((("Ann leads Acme.", "Ann", "Acme"), "Ann does not lead Acme."),),
    ),
    Template("helper", "sentiment_word", 'Is this sentence positive, negative or neutral? One word.\n"{INPUT_0}"'),
    Template("helper", "to_korean", f'Translate into Korean:\n"{{INPUT_0}}"\n{ONLY_TEXT}'),
    Template("helper", "to_german", f'Translate into German:\n"{{INPUT_0}}"\n{ONLY_TEXT}'),
    Template("helper", "to_english", f'Translate into English:\n"{{INPUT_0}}"\n{ONLY_TEXT}'),
    Template(
        "helper",
        "answers_question",
        f'Does this statement answer the question it replies to? {TRUE_FALSE}\n"{{INPUT_0}}"',
        ((("There are nine.",), "true"), (("The text does not say.",), "false")),
    ),
    Template("helper", "question_of_answer", 'Which question does this answer? Reply with the question.\n"{INPUT_0}"'),
)

ALL_TEMPLATES: dict[str, Template] = {
    t.key: t for t in (*SUT_PROMPTS, *REWRITE_PROMPTS, *RELATION_PROMPTS, *VERIFIER_PROMPTS, *HELPER_PROMPTS)
}

TEMPLATE_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField(
            "examples",
            T.ArrayType(
                T.StructType(
                    [T.StructField("inputs", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType())]
                )
            ),
        ),
        T.StructField("multi_input", T.BooleanType()),
    ]
)


def template(key: str) -> Template:
    """Look a template up by ``category:name``; an unknown one is an error, not an empty prompt."""
    if key not in ALL_TEMPLATES:
        raise KeyError(f"no template {key!r}")
    return ALL_TEMPLATES[key]


def templates_table(spark: SparkSession) -> DataFrame:
    rows = [
        (t.category, t.name, t.prompt, [(list(i), a) for i, a in t.examples], t.multi_input)
        for t in ALL_TEMPLATES.values()
    ]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)
