"""The classifiers once more, word by word and row by row, without any of the operators' arrays."""

import math
import re

import numpy as np

from skerry.llm import quality, toxicity

WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def held(text):
    """The features of a text: its words and their beginnings."""
    out = set()
    for w in WORDS.findall((text or "").encode()):
        w = re.sub(rb"[A-Z]+", lambda m: m[0].lower(), w)
        out.add(("word", w))
        out |= {(n, w[:n]) for n in (4, 5, 6) if len(w) > n}
    return out


def number(feature):
    """The operator's number of a feature, which only breaks ties."""
    kind, word = feature
    n = int(toxicity.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
    return n if kind == "word" else n ^ int(toxicity._TAGS[kind])


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def votes(text, lexicons):
    raw, own = (text or "").encode(), held(text)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    masked = re.search(rb"(?<=[0-9A-Za-z\x80-\xff])\*(?=[0-9A-Za-z\x80-\xff])", raw)
    return [float(bool(own & x)) for x in lexicons] + [float(upper > 20 and upper > lower), float(raw.count(b"!") >= 3), float(bool(masked))]


def logistic(x, soft, hold, rounds=200):
    """Minimum of the logistic loss with a ridge, by damped Newton steps on dense arrays."""
    w = np.zeros(x.shape[1])

    def cost(w):
        m = x @ w
        return float(np.logaddexp(0, m).sum() - soft @ m + (hold * w * w).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(hold + 1e-9), x.T @ (p - soft) + hold * w)
        share = 1.0
        while share > 1e-6 and cost(w - share * step) > cost(w):
            share /= 2
        w = w - share * step
        if np.abs(step).max() * share < 1e-9:
            break
    return w


def calibrated(x, y):
    """Slope and shift of the logistic fit of y on x."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    centre, scale = x.mean(), x.std() or 1.0
    a, b = logistic(np.stack([(x - centre) / scale, np.ones(len(x))], 1), y, np.array([1e-3, 1e-3]))
    return a / scale, b - a * centre / scale


def rates(table, prior):
    """Hit rates in toxic and clean text and the weight of each voter, from rows of votes."""
    n, m = len(table), len(table[0])
    mean = [sum(r[i] for r in table) / n for i in range(m)]
    cov = [[sum(r[i] * r[j] for r in table) / n - mean[i] * mean[j] for j in range(m)] for i in range(m)]
    spread = [math.sqrt(max(p * (1 - p), 1e-12)) for p in mean]
    live = [p > 0 for p in mean]
    use = [[i != j and live[i] and live[j] for j in range(m)] for i in range(m)]
    d = []
    for i in range(m):
        others = [j for j in range(m) if use[i][j]]
        seen = sorted(cov[i][j] * cov[i][k] / cov[j][k] for j in others for k in others if j < k and cov[j][k] > 1e-9)
        if seen:
            h = len(seen) // 2
            d.append(math.sqrt(max(0.0, seen[h] if len(seen) % 2 else (seen[h - 1] + seen[h]) / 2)))
        else:
            d.append(math.sqrt(max(0.0, sum(cov[i][j] for j in others) / len(others))) if others else 0.0)

    def rest(i, j):
        return (cov[i][j] - d[i] * d[j]) / (spread[i] * spread[j])

    for _ in range(2):
        tied = [[use[i][j] and abs(rest(i, j)) > 0.2 for j in range(m)] for i in range(m)]
        for _ in range(50):
            for i in range(m):
                others = [j for j in range(m) if use[i][j] and not tied[i][j]]
                weight = sum(d[j] ** 2 for j in others)
                d[i] = max(0.0, sum(cov[i][j] * d[j] for j in others) / weight) if weight > 0 else 0.0
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    toxic = [clip(mean[i] + d[i] * math.sqrt((1 - prior) / prior)) for i in range(m)]
    clean = [clip(mean[i] - d[i] * math.sqrt(prior / (1 - prior))) for i in range(m)]
    toxic = [max(a, b) for a, b in zip(toxic, clean, strict=True)]
    weight = [1 / (1 + sum(min(max(rest(i, j), 0), 1) for j in range(m) if tied[i][j])) for i in range(m)]
    return toxic, clean, weight


def toxic_scores(rows, labels):
    """Scores of all `rows` (id, text), learnt from `labels` (id -> 0 or 1) of some of them."""
    texts = dict(rows)
    sample = sorted(labels)
    n1 = sum(labels.values())
    n0 = len(labels) - n1
    has = {i: held(texts[i]) for i in sample}
    counts = {}
    for i in sample:
        for f in has[i]:
            counts.setdefault(f, [0, 0])[1 - labels[i]] += 1
    told = []
    for f, (a, b) in counts.items():
        if a + b >= 3:
            odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
            told.append((-abs(z := odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))), signed(number(f)), f, odds, z, a))
    told = sorted(told)[: toxicity.VOCABULARY]
    fixed = [("word", w.encode()) for w in toxicity.INSULTS]
    lists = fixed + [f for _, _, f, odds, z, a in told if odds >= 2.5 and z >= 3 and a >= 3 and f not in fixed]
    lexicons = [set(lists[k :: toxicity.LEXICONS]) for k in range(toxicity.LEXICONS)]
    prior = min(max((n1 + 1) / (n1 + n0 + 2), 1e-3), 0.5)
    toxic, clean, weight = rates([votes(t, lexicons) for _, t in rows], prior)

    def posterior(text):
        m = math.log(prior / (1 - prior))
        for v, a, b, w in zip(votes(text, lexicons), toxic, clean, weight, strict=True):
            m += w * (math.log(a / b) if v else math.log((1 - a) / (1 - b)))
        return 1 / (1 + math.exp(-min(max(m, -40), 40)))

    words = sorted({f for _, _, f, *_ in told} | set(fixed), key=str)
    line = lambda own: [float(f in own) for f in words] + [1.0]
    w = logistic(np.array([line(has[i]) for i in sample]), np.array([posterior(texts[i]) for i in sample]), np.append(np.full(len(words), 0.3), 1e-6))
    margin = lambda text: float(np.array(line(held(text))) @ w)
    slope, shift = calibrated([margin(texts[i]) for i in sample], [labels[i] for i in sample])
    return {i: 1 / (1 + math.exp(-min(max(margin(t) * slope + shift, -40), 40))) for i, t in rows}


def quality_scores(rows, labels):
    """Scores of all `rows` (id, text), learnt from `labels` (id -> 0 or 1) of some of them."""
    import zstandard

    texts = {i: (t or "").encode() for i, t in rows}
    compressors = []
    for kind in (1, 0):
        chunks = sorted((i * 2654435761 % 2**31, i, texts[i][k : k + 512]) for i in labels if labels[i] == kind for k in range(0, len(texts[i]), 512))
        chunks = [c for *_, c in chunks if len(c) >= 8]
        total = sum(map(len, chunks))
        try:
            own = zstandard.train_dictionary(min(65_536, max(1024, total // 8)), chunks).as_bytes()
        except zstandard.ZstdError:
            own = b"".join(chunks)[-65_536:]
        compressors.append(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(raw):
        good, bad = (sum(len(c.compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096)) for c in compressors)
        return (bad - good) / (bad + good) if raw else 0.0

    slope, shift = calibrated([difference(texts[i]) for i in sorted(labels)], [labels[i] for i in sorted(labels)])
    return {i: 1 / (1 + math.exp(-(difference(raw) * slope + shift))) for i, raw in texts.items()}
