"""The indicators, signals and cycles of one series, restated with plain loops."""

import datetime

DAY0 = datetime.datetime(2025, 1, 1)


def total(values):
    """One after the other; sum() compensates."""
    out = 0.0
    for x in values:
        out += x
    return out


def sma(c, p):
    return [total(c[i - p + 1 : i + 1]) / p if i >= p - 1 and len(c) >= p else 0.0 for i in range(len(c))]


def ema(c, p):
    out = [0.0] * len(c)
    if len(c) < p:
        return out
    out[p - 1] = total(c[:p]) / p
    for i in range(p, len(c)):
        out[i] = (c[i] - out[i - 1]) * (2 / (p + 1)) + out[i - 1]
    return out


def macd(c, f=12, s=26, g=9):
    if len(c) < s + g:
        return None
    fast, slow = ema(c, f), ema(c, s)
    dif = [fast[i] - slow[i] if i >= s - 1 else 0.0 for i in range(len(c))]
    dea = [0.0] * (s - 1) + ema(dif[s - 1 :], g)
    return dif, dea, [a - b for a, b in zip(dif, dea, strict=True)]


def kdj(h, lo, c, n=9, m1=3, m2=3):
    if len(c) < n:
        return None
    k, d = [0.0] * len(c), [0.0] * len(c)
    for i in range(n - 1, len(c)):
        top, bottom = max(h[i - n + 1 : i + 1]), min(lo[i - n + 1 : i + 1])
        rsv = 50.0 if top == bottom else (c[i] - bottom) / (top - bottom) * 100
        k[i] = rsv if i == n - 1 else (1 - 1 / m1) * k[i - 1] + 1 / m1 * rsv
        d[i] = rsv if i == n - 1 else (1 - 1 / m2) * d[i - 1] + 1 / m2 * k[i]
    return k, d, [3 * a - 2 * b for a, b in zip(k, d, strict=True)]


def rsi(c, p):
    out = [0.0] * len(c)
    if len(c) <= p:
        return out
    diff = [b - a for a, b in zip(c, c[1:], strict=False)]
    up, down = [max(x, 0.0) for x in diff], [max(-x, 0.0) for x in diff]
    gain, loss = total(up[:p]) / p, total(down[:p]) / p
    for i in range(p, len(c)):
        if i > p:
            gain, loss = (gain * (p - 1) + up[i - 1]) / p, (loss * (p - 1) + down[i - 1]) / p
        out[i] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return out


def crosses(a, b):
    d = [x - y for x, y in zip(a, b, strict=True)]
    return [0] + [1 if p <= 0 < q else -1 if p >= 0 > q else 0 for p, q in zip(d, d[1:], strict=False)]


def cycles(found, c):
    out, opened = [], None
    for i, x in enumerate(found):
        if x == 1 and opened is None:
            opened = i
        elif x == -1 and opened is not None:
            out.append((opened, i, (c[i] - c[opened]) / c[opened] * 100))
            opened = None
    return out
