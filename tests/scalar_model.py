"""The sentiment rules for one text in plain Python, written to check the DataFrame version against."""

import math
import string

from mentionmill.functions.wordlists import DAMPENERS, IDIOMS, INTENSIFIERS, NEGATIONS, PUNCTUATION

DEGREE = {**{w: 0.293 for w in INTENSIFIERS}, **{w: -0.293 for w in DAMPENERS}}


def clean(item):
    for mark in PUNCTUATION:
        for word in (item[: -len(mark)] if item.endswith(mark) else "", item[len(mark) :] if item.startswith(mark) else ""):
            if len(word) > 1 and not set(word) & set(string.punctuation):
                return word
    return item


def tokens(text):
    return [clean(item) for item in text.split() if len(item) > 1]


def lookup(word, lexicon):
    return next((lexicon[form] for form in (word, word.lower(), word.capitalize()) if form in lexicon), None)


def toward(value, amount):
    return value + amount if value > 0 else value - amount


def is_negation(word):
    return word in NEGATIONS or "n't" in word


def word_value(words, i, lexicon, mixed):
    low = [w.lower() for w in words]
    if low[i] in DEGREE or low[i : i + 2] == ["kind", "of"]:
        return 0.0
    value = lookup(words[i], lexicon)
    if value is None:
        return 0.0
    if mixed and words[i].isupper():
        value = toward(value, 0.733)
    for back, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        if i < back or low[i - back] in lexicon:
            continue
        degree = DEGREE.get(low[i - back], 0.0)
        if degree:
            push = -degree if value < 0 else degree
            if mixed and words[i - back].isupper():
                push = push + 0.733 if value > 0 else push - 0.733
            value += push * weight
        near = low[max(i - 3, 0) : i][::-1]
        if back == 2 and near[1] == "never" and near[0] in ("so", "this"):
            value *= 1.25
        elif back == 2 and near[1] == "without" and near[0] == "doubt":
            pass
        elif back == 3 and ((near[2] == "never" and near[1] in ("so", "this")) or near[0] in ("so", "this")):
            value *= 1.25
        elif back == 3 and near[2] == "without" and "doubt" in near[:2]:
            pass
        elif is_negation(near[back - 1]):
            value *= -0.74
        if back == 3:
            spans = [(i - 1, i + 1), (i - 2, i + 1), (i - 2, i), (i - 3, i), (i - 3, i - 1)]
            found = [IDIOMS[p] for p in (" ".join(low[a:b]) for a, b in spans) if p in IDIOMS]
            value = found[0] if found else value
            for end in (i + 2, i + 3):
                if end <= len(low):
                    value = IDIOMS.get(" ".join(low[i:end]), value)
    if i and low[i - 1] == "least" and "least" not in lexicon and (i == 1 or low[i - 2] not in ("at", "very")):
        value *= -0.74
    return value


def contrast(words, values):
    low = [w.lower() for w in words]
    if "but" not in low:
        return values
    pivot = low.index("but")
    for k in range(len(values)):
        place = values.index(values[k])
        values[place] *= 0.5 if place < pivot else 1.5 if place > pivot else 1.0
    return values


def score(text, lexicon, emoji=None):
    text = " ".join((emoji or {}).get(item, item) for item in text.split())
    words = tokens(text)
    if not words:
        return {"neg": 0.0, "neu": 0.0, "pos": 0.0, "compound": 0.0}
    capitals = sum(w.isupper() for w in words)
    mixed = 0 < capitals < len(words)
    values = contrast(words, [word_value(words, words.index(w), lexicon, mixed) for w in words])
    questions = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0.96 if questions > 3 else questions * 0.18 if questions > 1 else 0)
    total = 0.0
    for v in values:
        total += v
    total += emphasis * ((total > 0) - (total < 0))
    up = down = 0.0
    for v in values:
        up, down = (up + v + 1, down) if v > 0 else (up, down + 1 - v) if v < 0 else (up, down)
    if up > down:
        up += emphasis
    elif up < down:
        down += emphasis
    neutral = values.count(0)
    whole = up + down + neutral
    compound = max(-1.0, min(1.0, total / math.sqrt(total * total + 15)))
    return {
        "neg": round(down / whole, 3),
        "neu": round(neutral / whole, 3),
        "pos": round(up / whole, 3),
        "compound": round(compound, 4),
    }
