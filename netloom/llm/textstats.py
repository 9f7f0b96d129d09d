"""Statistics of whole texts, by numpy over bytes and by word lists."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
_UPPER, _LOWER, _DIGIT = (np.array([chr(i).isascii() and f(chr(i)) for i in range(256)]) for f in (str.isupper, str.islower, str.isdigit))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_HIGH = np.arange(256) >= 128
_PUNCT = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_PLAIN = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-?()"])

QUALITY_STATS = (
    "log_words", "mean_word", "long_words", "short_words", "distinct", "top_word", "top_five", "repeat_next", "upper", "digit", "symbol", "punct", "high", "bang",
    "pipe", "upper_words", "log_lines", "log_words_line", "repeat_lines", "pairs_distinct", "ends_line", "word_entropy",
)


def quality(text: str) -> list[float]:
    """QUALITY_STATS of one whole text; an empty text has zeros."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(QUALITY_STATS)
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = int(count.sum())
    letters = max(1, int(count[_UPPER | _LOWER | _HIGH].sum()))
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    words = Counter(tokens)
    f = np.fromiter(words.values(), np.float64, len(words)) / n
    top = np.sort(f)[::-1]
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(tokens, tokens[1:])))
    repeat = sum(map(str.__eq__, tokens, tokens[1:]))
    return [
        np.log1p(n), lengths.mean(), (lengths > 12).mean(), (lengths < 3).mean(), len(words) / n ** 0.8, top[0], top[:5].sum(), repeat / n,
        count[_UPPER].sum() / letters, count[_DIGIT].sum() / size, count[_PUNCT & ~_PLAIN].sum() / size, count[_PUNCT & _PLAIN].sum() / size, count[_HIGH].sum() / size, count[33] / n,
        count[124] / n, sum(map(str.isupper, tokens)) / n, np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), pairs / max(1, n - 1),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)), float(-(f * np.log(f)).sum()) / np.log(n + 1),
    ]


#: General English insults: fixed seed of the toxicity lexicon; more words are learned from the training labels.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum disgusting clown clowns fool fools freak jerk creep liar hate shut filthy vile ugly dirtbag imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre usted tus".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
#: Runs that mix letters with digits or signs; possessive, and tried only where a run begins, so that every text takes linear time.
_MIXED = re.compile(r"(?<![A-Za-z0-9@$!|*])(?:[A-Za-z]++[0-9@$!|*]|[0-9@$!|*]++[A-Za-z])[A-Za-z0-9@$!|*]*+")
_STRETCH = re.compile(r"([A-Za-z])\1{2,}")
TOXIC_STATS = (
    "seed_density", "seed_log", "learned_density", "learned_log", "learned_weight", "distinct_seed", "near_second_person", "second_person", "upper", "upper_words", "bang", "question", "punct", "symbol",
    "mixed", "leet_hits", "stretched", "masked", "log_words", "repeat_next",
)


def toxicity(text: str, learned: dict[str, float]) -> list[float]:
    """TOXIC_STATS of one whole text; an empty text has zeros. learned: weights of the learned lexicon's words."""
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(TOXIC_STATS)
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, letters = int(count.sum()), max(1, int(count[_UPPER | _LOWER | _HIGH].sum()))
    kinds = set(words)
    seeds, known = kinds & INSULTS, kinds & learned.keys()
    at_seed = [i for i, w in enumerate(words) if w in seeds or w in known] if seeds or known else []
    n_seed, n_known = (sum(words[i] in INSULTS for i in at_seed), sum(words[i] in learned for i in at_seed)) if at_seed else (0, 0)
    second = kinds & SECOND_PERSON
    near = sum(not second.isdisjoint(words[max(0, i - 5) : i + 6]) for i in at_seed) if second else 0
    mixed = leet = 0
    if count[_DIGIT].any() or count[[33, 36, 42, 64, 124]].any():
        for x in _MIXED.findall(text):
            if len(x) < 3:
                continue
            mixed += 1
            plain = x.lower().translate(_LEET)
            leet += plain in INSULTS or plain in learned
    tokens = text.split()
    return [
        n_seed / n, np.log1p(n_seed), n_known / n, np.log1p(n_known), sum(learned[w] for w in known), len(seeds), near, (sum(w in second for w in words) / n) if second else 0.0,
        count[_UPPER].sum() / letters, sum(map(str.isupper, tokens)) / max(1, len(tokens)), count[33] / n, count[63] / n, count[_PUNCT].sum() / size, count[_PUNCT & ~_PLAIN].sum() / size,
        mixed / n, np.log1p(leet), len(_STRETCH.findall(text)) / n, count[42] / n, np.log1p(n), sum(map(str.__eq__, words, words[1:])) / n,
    ]
