"""Batch functions that stand in for a model endpoint. Workers import this module, so it needs nothing else."""

from driftline.operators.model_calls import BatchModel, ContentFiltered, RepetitivePrompt


def batch_model(name, answer, **more):
    return BatchModel(name, answer, parallelism=8, wait_seconds=0.0, **more)


def length_of_question(chats):
    return [f"n={len(chat[-1]['content'])}" for chat in chats]


def refuse_some(chats):
    def one(chat):
        n = len(chat[-1]["content"])
        return {0: ContentFiltered(), 1: RepetitivePrompt()}.get(n % 3, f"n={n}")

    return [one(chat) for chat in chats]


class AnswerSecondTime:
    """Every first try fails; questions whose length is a multiple of five fail always.

    Only texts that wait for their second try are remembered, so a task holds those of one batch, not all of its texts.
    """

    def __init__(self):
        self.seen = set()

    def __call__(self, chats):
        waiting, out = set(), []
        for chat in chats:
            text = chat[-1]["content"]
            if len(text) % 5 and text in self.seen:
                out.append(f"n={len(text)}")
                continue
            out.append(RuntimeError("try again"))
            if len(text) % 5:
                waiting.add(text)
        self.seen = waiting
        return out


def rate_chats(chats):
    """The rating rule of the column double, on the text between the quotes of the prompt."""
    out = []
    for chat in chats:
        text = chat[-1]["content"].split('"', 1)[1].rsplit('"', 1)[0].lower()
        half = sum(map(text.count, "abcdefghijklm"))
        letters = half + sum(map(text.count, "nopqrstuvwxyz"))
        out.append(f"0.{min(99, half * 100 // letters):02d}" if letters else "n/a")
    return out


def fail_some(chats):
    """A question whose length is a multiple of five fails."""
    sizes = [len(chat[-1]["content"]) for chat in chats]
    return [f"n={n}" if n % 5 else RuntimeError("down") for n in sizes]


def length_of_last_quote(chats):
    return [f"n={len(chat[-1]['content'].split(chr(34), 1)[1].rsplit(chr(34), 1)[0])}" for chat in chats]


def one_reply_less(chats):
    return ["reply"] * (len(chats) - 1)


def answer_in_later_rounds(chats, round_):
    """A question of length n fails in its first n % 4 rounds."""
    sizes = [len(chat[-1]["content"]) for chat in chats]
    return [f"n={n}" if n % 4 <= round_ else RuntimeError("not yet") for n in sizes]


def load_letter_counts():
    return lambda texts: [[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
