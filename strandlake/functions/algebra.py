"""Exact comparison of short formulas: quotients of polynomials in letters and roots, percentages, tuples, sets and intervals.

A formula is read into a quotient of two polynomials with rational coefficients. Letters and other signs are unknowns; the root of
a whole number is an unknown whose square is that number, once its square factors are out. Two quotients are equal if the products
across are. What can't be read so is no formula.
"""

from __future__ import annotations

import re
from fractions import Fraction

#: Longest formula, most terms and largest power that are worked out; beyond that a text is no formula.
LONGEST, TERMS, POWER = 400, 400, 24
Monomial = tuple[tuple[str, int], ...]
Polynomial = dict[Monomial, Fraction]
_TOKENS = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+|\\[a-zA-Z]+|\\%|[a-zA-Zπ√]|[-+*/^(){}%!·×÷])")
_NOISE = re.compile(r"\\(?:left|right|displaystyle|,|;|!|:| )|\$|~")
_SAME = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cdot": "*", "\\times": "*", "·": "*", "×": "*", "\\div": "/", "÷": "/", "π": "\\pi", "√": "\\sqrt", "\\%": "%"}


class NoFormula(ValueError):
    pass


def _roots(n: int) -> tuple[int, int]:
    """n as a square times a number without square factors: (root of the square, the rest)."""
    if n > 10**9:
        raise NoFormula
    out, k = 1, 2
    while k * k <= n:
        while n % (k * k) == 0:
            n, out = n // (k * k), out * k
        k += 1
    return out, n


def _reduced(powers: dict[str, int]) -> tuple[Fraction, Monomial]:
    """Even powers of roots become numbers."""
    factor, kept = Fraction(1), {}
    for name, k in powers.items():
        if name.startswith("root "):
            factor *= Fraction(int(name[5:])) ** (k // 2)
            k %= 2
        if k:
            kept[name] = k
    roots = [int(n[5:]) for n in kept if n.startswith("root ")]
    if len(roots) > 1:  # one root of the product
        product = 1
        for r in roots:
            product *= r
            del kept[f"root {r}"]
        out, rest = _roots(product)
        factor *= out
        if rest > 1:
            kept[f"root {rest}"] = 1
    return factor, tuple(sorted(kept.items()))


def _plus(a: Polynomial, b: Polynomial, sign: int = 1) -> Polynomial:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + sign * c
    return {m: c for m, c in out.items() if c}


def _times(a: Polynomial, b: Polynomial) -> Polynomial:
    if len(a) * len(b) > TERMS:
        raise NoFormula
    out: Polynomial = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for name, k in n:
                powers[name] = powers.get(name, 0) + k
            factor, key = _reduced(powers)
            out[key] = out.get(key, Fraction(0)) + c * d * factor
    return {m: c for m, c in out.items() if c}


ONE: Polynomial = {(): Fraction(1)}


class Quotient:
    def __init__(self, top: Polynomial, bottom: Polynomial = ONE):
        if not bottom:
            raise NoFormula
        self.top, self.bottom = top, bottom

    def plus(self, o: Quotient, sign: int = 1) -> Quotient:
        return Quotient(_plus(_times(self.top, o.bottom), _times(o.top, self.bottom), sign), _times(self.bottom, o.bottom))

    def times(self, o: Quotient) -> Quotient:
        return Quotient(_times(self.top, o.top), _times(self.bottom, o.bottom))

    def over(self, o: Quotient) -> Quotient:
        return Quotient(_times(self.top, o.bottom), _times(self.bottom, o.top))

    def number(self) -> Fraction | None:
        if set(self.top) <= {()} and set(self.bottom) == {()}:
            return self.top.get((), Fraction(0)) / self.bottom[()]
        return None

    def same(self, o: Quotient) -> bool:
        return not _plus(_times(self.top, o.bottom), _times(o.top, self.bottom), -1)

    def power(self, o: Quotient) -> Quotient:
        k = o.number()
        if k == Fraction(1, 2):
            return self.root()
        if k is None or k.denominator != 1 or abs(k) > POWER:
            raise NoFormula
        out = Quotient(ONE)
        for _ in range(abs(int(k))):
            out = out.times(self)
        return out if k >= 0 else Quotient(ONE).over(out)

    def root(self) -> Quotient:
        n = self.number()
        if n is None or n < 0:
            raise NoFormula
        out, rest = _roots(n.numerator * n.denominator)  # of p / q: that of p * q, over q
        key: Monomial = ((f"root {rest}", 1),) if rest > 1 else ()
        return Quotient({key: Fraction(out, n.denominator)} if n else {})


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise NoFormula
            self.tokens.append(_SAME.get(m[1], m[1]))
            at = m.end()
        self.at = 0

    def see(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        t = self.see()
        if not t or wanted and t != wanted:
            raise NoFormula
        self.at += 1
        return t

    def sum(self) -> Quotient:
        out = self.product()
        while self.see() in ("+", "-"):
            sign = 1 if self.take() == "+" else -1
            out = out.plus(self.product(), sign)
        return out

    def product(self) -> Quotient:
        out = self.signed()
        while (t := self.see()) and t not in ("+", "-", ")", "}"):
            if t in ("*", "/"):
                out = out.times(self.signed()) if self.take() == "*" else out.over(self.signed())
            else:
                out = out.times(self.powered())
        return out

    def signed(self) -> Quotient:
        if self.see() in ("+", "-"):
            sign = self.take()
            out = self.signed()
            return out if sign == "+" else Quotient({}).plus(out, -1)
        return self.powered()

    def powered(self) -> Quotient:
        out = self.atom()
        while self.see() in ("%", "!"):
            if self.take() == "!":
                raise NoFormula
            out = out.over(Quotient({(): Fraction(100)}))
        if self.see() == "^":
            self.take()
            out = out.power(self.group() if self.see() in "{(" else self.signed_atom())
        return out

    def signed_atom(self) -> Quotient:
        if self.see() == "-":
            self.take()
            return Quotient({}).plus(self.atom(), -1)
        return self.atom()

    def group(self) -> Quotient:
        close = {"(": ")", "{": "}"}.get(self.take())
        if not close:
            raise NoFormula
        out = self.sum()
        self.take(close)
        return out

    def argument(self) -> Quotient:
        """Of a command: a group, or one sign or digit."""
        if self.see() in ("{", "("):
            return self.group()
        t = self.see()
        if re.fullmatch(r"\d{2,}", t):  # \frac12 is a half
            self.tokens[self.at : self.at + 1] = [t[0], t[1:]]
        return self.atom()

    def atom(self) -> Quotient:
        t = self.see()
        if t in ("(", "{"):
            return self.group()
        self.take()
        if t[0].isdigit() or t[0] == ".":
            return Quotient({(): n} if (n := Fraction(t.rstrip("."))) else {})
        if t == "\\frac":
            top = self.argument()
            return top.over(self.argument())
        if t == "\\sqrt":
            return self.argument().root()
        if re.fullmatch(r"[a-zA-Z]|\\[a-zA-Z]+", t) and t not in ("\\text", "\\mathrm", "\\in", "\\cup", "\\cap", "\\pm", "\\mp", "\\leq", "\\geq", "\\le", "\\ge", "\\neq", "\\approx"):
            return Quotient({((t, 1),): Fraction(1)})
        raise NoFormula


def formula(text: str) -> Quotient | None:
    """A text as a quotient of polynomials; None if it is none."""
    t = _NOISE.sub(" ", text).replace("\\{", "{").replace("\\}", "}").strip().rstrip(".")
    while re.search(r"\d,\d{3}(?!\d)", t):
        t = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t)
    if not t or len(t) > LONGEST or re.search(r"[a-zA-Z]{3,}", re.sub(r"\\[a-zA-Z]+", "", t)):
        return None  # words are no products of letters
    try:
        reader = _Reader(t)
        out = reader.sum()
        return out if reader.at == len(reader.tokens) else None
    except (NoFormula, ZeroDivisionError, RecursionError):
        return None


def parts(text: str) -> tuple[str, list[str]] | None:
    """A tuple, interval or set as its brackets and its members; None for anything else."""
    t = _NOISE.sub("", text).strip().rstrip(".")
    opened, closed = (("\\{", "\\}") if t.startswith("\\{") and t.endswith("\\}") else (t[:1], t[-1:]))
    if opened not in ("(", "[", "{", "\\{") or closed not in (")", "]", "}", "\\}") or (opened in ("{", "\\{")) != (closed in ("}", "\\}")):
        return None
    body, out, depth, last = t[len(opened) : len(t) - len(closed)], [], 0, 0
    for i, c in enumerate(body):
        depth += (c in "([{") - (c in ")]}")
        if depth < 0:
            return None
        if c == "," and not depth:
            out.append(body[last:i])
            last = i + 1
    out.append(body[last:])
    if depth or (len(out) < 2 and opened not in ("{", "\\{")):
        return None
    return opened[-1] + closed[-1], out


def same(a: str, b: str) -> bool:
    """Whether two texts are the same formula, tuple, interval or set of formulas."""
    p, q = parts(a), parts(b)
    if p or q:
        if not (p and q) or p[0] != q[0]:
            return False
        if p[0] == "{}":
            return all(any(same(x, y) for y in q[1]) for x in p[1]) and all(any(same(x, y) for x in p[1]) for y in q[1])
        return len(p[1]) == len(q[1]) and all(map(same, p[1], q[1]))
    x, y = formula(a), formula(b)
    if x is None or y is None:
        return False
    try:
        return x.same(y)
    except NoFormula:
        return False
