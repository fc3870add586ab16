"""Examples of sound and defective pairs, made from unrated ones: what problem 4's field and regression are fitted on.

A sampled response counts as sound if it holds a number that its question lacks and ends neither open nor inside brackets. From
sound responses come cut-off ones, ones in another language, ones behind their question or with a broken tail; from questions come
altered copies; refusals come from general wordings. Responses that show nothing of this are not learned from.
"""

from __future__ import annotations

import random
import re

from millrace.llm import languages as L
from millrace.llm.text import folded, words

# General wordings of refusals. `*` stands for a word of the question.
REFUSALS = {
    "en": [
        "I'm sorry, but I can't help with that.", "I cannot assist with this request.", "I am unable to answer that question.", "I can't provide an answer to this.", "Unfortunately I cannot do that.",
        "I must refuse to answer.", "I decline to respond.", "I won't answer this question.", "Sorry, I am not able to give a solution here.", "I would rather not discuss *.", "I prefer not to say.",
        "As an AI language model, I cannot solve this for you.", "This is something I can't work on.", "My guidelines don't allow me to talk about this.", "I'm not comfortable discussing *, please ask someone else.",
        "This request is outside of what I am able to do.", "Please consult an expert or a teacher about this.", "No answer can be provided here.", "Helping with * could be unsafe, so I have to decline.",
        "I will not be providing this.", "Is there anything else I can do for you?", "Not able to help with this", "Unable to respond", "You ask about *, but I can't help there.",
    ],
    "de": [
        "Es tut mir leid, aber dabei kann ich nicht helfen.", "Diese Frage kann ich leider nicht beantworten.", "Ich möchte dazu lieber nichts sagen.", "Das muss ich ablehnen.", "Leider darf ich diese Aufgabe nicht lösen.",
        "Ich kann keine Antwort geben.", "Bitte wenden Sie sich an eine Lehrkraft.",
    ],
    "fr": [
        "Je suis désolé, mais je ne peux pas aider pour cela.", "Je ne peux pas répondre à cette question.", "Je préfère ne pas en parler.", "Je dois refuser cette demande.", "Désolé, je ne suis pas en mesure de résoudre ce problème.",
        "Aucune réponse ne sera donnée ici.", "Adressez-vous à un professeur.",
    ],
    "es": [
        "Lo siento, pero no puedo ayudar con eso.", "No puedo responder a esta pregunta.", "Prefiero no contestar.", "Debo rechazar esta solicitud.", "Lamentablemente no me es posible resolver esta tarea.",
        "Aquí no se dará ninguna respuesta.", "Por favor, consulte a un profesor.",
    ],
    "ru": [
        "Извините, но я не могу с этим помочь.", "Я не могу ответить на этот вопрос.", "Предпочитаю не отвечать.", "Вынужден отказаться.", "К сожалению, я не в состоянии решить эту задачу.", "Обратитесь, пожалуйста, к учителю.",
    ],
    "zh": ["抱歉，我无法帮助您。", "对不起，我不能回答这个问题。", "我不想讨论这个。", "我必须拒绝这个请求。", "很遗憾，我无法解答此题。", "请咨询老师。"],
}
# Results told in words.
VERBAL = {
    "en": """no solution|no real roots|undefined|not defined|does not exist|none|none of these|none of the above|infinitely many|all of them|all real numbers|every one|impossible|never|always|
        \\varnothing|\\text{Friday}|\\text{even}|\\text{no solution}|twenty-one|five|seven|thirteen|ninety-nine|one half|two thirds|zero|Tuesday|red|even|odd|true|false|yes|no|both|neither|all but two|
        half of them|two more|the first one|all of those|one of them|half of it|neither of the two|empty set|\\infty|exactly one|at most three|sixty-four boxes""",
    "de": "keine Lösung|nicht definiert|alle|sieben|einundzwanzig Stück|neunundneunzig|die Hälfte|zwei Drittel|unendlich viele|fünfzehn Kisten|hundertdrei|unmöglich",
    "fr": "aucune solution|non défini|tous|sept|vingt et un|soixante-trois caisses|la moitié|deux tiers|une infinité|cent quatre|quinze boîtes",
    "es": "ninguna solución|no definido|todos|siete|veintiuno|sesenta y tres cajas|la mitad|dos tercios|infinitas|ciento cuatro|imposible|quince piezas",
    "ru": "решений нет|не определено|все|семь|двадцать один|шестьдесят три коробки|половина|две трети|бесконечно много|сто четыре|невозможно|пятнадцать штук",
    "zh": "无解|没有定义|全部|七|二十一|六十三个|一半|三分之二|无穷多|一百零四|不可能|十五个",
}
#: Openings of a repeated question or of a text that was cut, as fixed values.
_OPENINGS = ("", "", "", "Question: ", "Problem: ", "Answer: ", "You asked: ", "The task: ", "Here is the problem. ", "**", "> ")
_CUTS = ("", "", "", "", "...", "…", " [truncated]", " [cut off]", " <length limit>", " -")
_DANGLING = (" +", " -", " =", "/", " \\cdot", " \\times", "^", " *")
_UNCLOSED = ("\\frac{{{}}}{{", "\\sqrt{{{}", "\\boxed{{{}", "({}, ", "\\frac{{{}", "\\left( {}", "${}", "x =", "\\text{{it is", "{}^{{")
_LEADS = ("so we get $\\frac{1", "Now, using the", "Then we", "Next, we take", "Hence $x = ", "that is, the", "Also \\boxed{")

_FRAGMENTS = ("the sum of", "the value of the", "a total of", "equal to the", "the amount of", "it is the", "this is because", "the remaining number of", "so that the", "which is a")
#: Frames that leave a result whole.
_CLOSED = ("{}", "{}.", "${}$", "\\boxed{{{}}}", "**{}**", "({})", "$\\boxed{{{}}}$", "= {}", "{} ", "`{}`", "x = {}", "$n = {}$", "a = {0} or a = -{0}", "x = {0}, y = {0}", "approximately {}")

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)


def _altered(question: str, other: str, rng: random.Random) -> str:
    """A copy of a question: as it is, or with words dropped, put in or in other case, or without a sentence."""
    text = question
    kind = rng.randrange(7)
    if kind == 5:
        text = re.sub(r"[^\w\s$\\{}^_*/+-]", " ", text)
    elif kind == 1:
        text = text.upper()
    elif kind == 2:
        spare = other.split() or ["now"]
        text = " ".join(x for w in text.split() for x in ([] if rng.random() < 0.06 else [w, rng.choice(spare)] if rng.random() < 0.06 else [w]))
    elif kind == 3:
        parts = re.split(r"(?<=[.!?])\s+", text)
        if len(parts) > 2:
            parts.pop(rng.randrange(len(parts)))
        text = " ".join(parts)
    elif kind == 4:
        parts = re.split(r"(?<=[.!?])\s+", text)
        rng.shuffle(parts)
        text = " ".join(parts)
    return rng.choice(_OPENINGS) + text if kind % 2 == 0 else text


def _in_language(text: str, name: str, rng: random.Random) -> str:
    """A text whose words are replaced by frequent ones of a language; numbers, formulas and capitalised names stay."""
    known = L.FREQUENT[name].split()
    return re.sub(r"(?<![\\\w])(?!boxed)[a-zà-öø-ÿа-яё]{2,}|[A-ZА-Я][a-zà-öø-ÿа-яё]{1,3}\b|[一-鿿]", lambda m: rng.choice(known), text)


def _parts(text: str) -> list[str]:
    return [p for p in re.split(r"(\n+|(?<=[.!?])\s+)", text)]


def examples(rows: list[tuple[str | None, str | None, bool]], model, refusals: dict[str, list[str]] | None = None, seed: int = 11) -> list:
    """(question, [(text, tag), ...], short, defect) of the examples; `refusals` stand in for the general wordings."""
    rng = random.Random(seed)
    refusals = refusals or REFUSALS
    seen = sorted({w for q, r, _ in rows for t in (q, r) if t for w in words(t)})
    place, score = {w: i for i, w in enumerate(seen)}, model.languages.scores(seen)
    spare = [q for q, _, _ in rows if q and words(q)] or ["How many are left?"]

    def spoken(text: str, without: set[str]) -> tuple[int, float]:
        w = [place[x] for x in words(text) if not x.isdigit() and x not in without]
        if not w:
            return -1, 0.0
        total = score[w].sum(axis=0)
        first, second = sorted(total, reverse=True)[:2]
        return int(total.argmax()), float(first - second)

    def refusal(name: str, question: str) -> str:
        own = [w for w in question.split() if w.isalpha() and len(w) > 3] or ["this"]
        return rng.choice(refusals.get(name) or refusals["en"]).replace("*", rng.choice(own))

    out: list = []
    names = list(L.NAMES)
    verbal = {k: [x.strip() for x in v.split("|")] for k, v in VERBAL.items()}
    for i, (question, response, short) in enumerate(rows):
        other = rng.choice(spare)
        asked = set(words(question))
        mine, sure = spoken(question, set()) if question else (-1, 0.0)
        name = names[mine] if mine >= 0 and sure > 3 else "en"
        foreign = rng.choice([n for n in names if n != name])
        # Refusals, copies and verbal results don't need a sound response.
        q = question or other
        if i % 3 == 0:
            said = [(refusal(name, q), REFUSAL) for _ in range(rng.choice((1, 1, 1, 2)))]
            if rng.random() < 0.15:
                said.insert(0, (_altered(q, other, rng), ECHO))
            out.append((q, said, bool(i % 2), "refusal"))
        if i % 4 == 1:
            out.append((q, [(_altered(q, other, rng), ECHO)], bool(i // 4 % 2), "copy"))
        if i % 4 == 2:
            out.append((q, [(rng.choice(verbal[name]), ANSWER)], True, None))
            some = rng.choice(verbal[foreign]) if rng.random() < 0.7 else " ".join(rng.sample(L.FREQUENT[foreign].split(), 2))
            out.append((q, [(some + rng.choice(("", "", f" ({rng.randint(1, 99)})")), FOREIGN)], True, "language"))
        if not response or not question:
            continue
        low = folded(response).strip()
        numbers = {w for w in words(response) if any(c.isdigit() for c in w)}
        paired = all(low.count(a) == low.count(b) for a, b in ("{}", "()")) and (low.count("$") - low.count("\\$")) % 2 == 0
        if not numbers - asked or not paired or not re.search(r"[\w.)}\]$*!?。%]$", low) or low.endswith("..."):
            continue
        tongue, margin = spoken(response, asked)
        if short:
            if margin > 1.5 and tongue != mine:  # perhaps in another language: neither sound nor surely not
                continue
            value = re.sub(r"[^\d.]", "", response)[:4] or "7"
            out.append((question, [(response, ANSWER)], True, None))
            if i % 5 == 0:
                things = [w for w in words(other) if w.isalpha() and len(w) > 3] or ["pieces"]
                told = response if any(c.isalpha() for c in response) else f"{response} {rng.choice(things)}" if i % 2 else rng.choice(_CLOSED).format(response)
                out.append((question, [(told, ANSWER)], True, None))
            if i % 3 == 0:
                broken = value + rng.choice(_DANGLING) if rng.random() < 0.4 else rng.choice(_UNCLOSED).format(value) if rng.random() < 0.7 else rng.choice(_FRAGMENTS) if rng.random() < 0.5 else " ".join([w for w in words(other) if w.isalpha()][1 : rng.randint(3, 6)]) + rng.choice((" of", " the", " and"))
                out.append((question, [(broken, UNFINISHED)], True, "truncated"))
            continue
        w, q = words(response), words(question)
        if len(set(zip(w, w[1:], strict=False)) & set(zip(q, q[1:], strict=False))) > 0.4 * len(w):
            continue
        parts = _parts(response.strip())
        closing = parts[-1]
        if re.search(r"[a-z]$", closing) or not re.search(r"\d|\\[a-z]+", closing):
            continue
        if mine >= 0 and sure > 3 and tongue >= 0 and margin > 6 and tongue != mine:
            out.append((question, [(response, FOREIGN)], False, "language"))
            continue
        sound = [(response, ANSWER)]
        out.append((question, sound, False, None))
        kind = i % 8
        if kind in (0, 1, 2):
            least = 3 if rng.random() < 0.5 else max(3, len(response.strip()) - len(closing))
            most = len(response.strip()) - (1 if "{" in closing else len(closing))
            if most > least:
                cut = response.strip()[: rng.randint(least, most)].rstrip()
                tail = rng.choice(_CUTS)
                part = _parts(cut)[-1]
                if "{" in part and part.count("{") == part.count("}"):
                    pass  # whole as it stands
                elif tail or not re.search(r"[.!?。\d]$", cut) or re.search(r"\d\s*[-+*/]\s*\d+$", cut):
                    out.append((question, [(cut + tail, UNFINISHED)], False, "truncated"))
                if len(parts) > 2 and rng.random() < 0.5:
                    out.append((question, [("".join(parts[: 2 * rng.randrange(1, len(parts) // 2 + 1)]) + "\n" + rng.choice(_LEADS), UNFINISHED)], False, "truncated"))
        elif kind == 3:
            out.append((question, [(_in_language(response, foreign, rng), FOREIGN)], False, "language"))
        elif kind == 4:
            out.append((_in_language(question, foreign, rng), [(_in_language(response, foreign, rng), ANSWER)], False, None))
        elif kind == 5:
            out.append((question, [(_altered(question, other, rng), ECHO), (response, ANSWER)], False, None))
        elif kind == 7:
            framed = rng.choice(("**{}**", "{}\n\n", "Solution. {}", "> {}", "{}**", "$$ $$\n{}"))
            changed = rng.choice((str, str, str.upper, str.lower))(response) if "\\" not in response else response
            out.append((question, [(framed.format(changed) if "{" not in changed else framed.replace("{}", changed), ANSWER)], False, None))
        elif kind == 6:
            out.append((question, [(response, ANSWER), (rng.choice(_LEADS), UNFINISHED)], False, None))
    return out
