"""Plain-Python definitions of the scores, one pair at a time, for comparison."""

import math
import re
import string
from collections import Counter

PUNCT = set(string.punctuation)


def tokens(text):
    return re.findall(r"\w+|[^\w\s]", text.lower())


def chrf_words(text):
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in PUNCT:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in PUNCT:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def bleu_tokens(text):
    text = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(name, char)
    text = f" {text} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def grams(seq, n):
    return Counter(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))


def stats(hyp, ref, orders):
    rows = []
    for n in range(1, orders + 1):
        h, r = grams(hyp, n), grams(ref, n)
        rows.append((h.total(), r.total(), (h & r).total()))
    return rows


def chrf_vector(hyp, ref):
    rows = stats("".join(hyp.split()), "".join(ref.split()), 6) + stats(chrf_words(hyp), chrf_words(ref), 2)
    return [(h if r else 0, r, m) for h, r, m in rows]


def bleu_vector(hyp, ref):
    return stats(bleu_tokens(hyp), bleu_tokens(ref), 4)


def add(vectors):
    return [tuple(map(sum, zip(*rows))) for rows in zip(*vectors)]


def chrf(vector):
    used = [(h, r, m) for h, r, m in vector if h and r]
    if not used:
        return 0.0
    p = sum(m / h for h, r, m in used) / len(used)
    r = sum(m / r for h, r, m in used) / len(used)
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def bleu(vector):
    if not any(m for _, _, m in vector) or not all(h for h, _, _ in vector):
        return 0.0
    smooth, logs = 1, []
    for h, _, m in vector:
        if m == 0:
            smooth *= 2
        logs.append(math.log(100 * m / h if m else 100 / (smooth * h)))
    hyp_len, ref_len = vector[0][0], vector[0][1]
    brevity = math.exp(1 - ref_len / hyp_len) if hyp_len < ref_len else 1.0
    return brevity * math.exp(sum(logs) / 4)


def mbr(texts, metric="geo"):
    """(text, utility) of every distinct candidate."""
    texts = list(dict.fromkeys(texts))
    out = []
    for hyp in texts:
        others = [t for t in texts if t != hyp]
        c = sum(chrf(chrf_vector(hyp, t)) for t in others) / len(others) if others else 0.0
        b = sum(bleu(bleu_vector(hyp, t)) for t in others) / len(others) if others else 0.0
        out.append((hyp, {"chrf": c, "bleu": b, "geo": math.sqrt(c * b)}[metric]))
    return out
