"""Fields: symbolic expressions over labelled columns that lower to Spark columns.

An expression knows its exact derivative with respect to a column, so differential
operators become ordinary projections that Catalyst prunes, folds and compiles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Expr:
    """Base of all nodes; numbers are taken as constants."""

    def __add__(self, o):
        return add(self, lift(o))

    def __radd__(self, o):
        return add(lift(o), self)

    def __mul__(self, o):
        return mul(self, lift(o))

    def __rmul__(self, o):
        return mul(lift(o), self)

    def __neg__(self):
        return mul(Const(-1.0), self)

    def __sub__(self, o):
        return add(self, -lift(o))

    def __rsub__(self, o):
        return add(lift(o), -self)

    def __truediv__(self, o):
        return mul(self, power(lift(o), -1.0))

    def __rtruediv__(self, o):
        return mul(lift(o), power(self, -1.0))

    def __pow__(self, n):
        return power(self, float(n))


@dataclass(frozen=True)
class Const(Expr):
    value: float

    def column(self) -> Column:
        return F.lit(self.value)

    def diff(self, name: str) -> Expr:
        return ZERO

    def labels(self) -> frozenset[str]:
        return frozenset()


@dataclass(frozen=True)
class Label(Expr):
    name: str

    def column(self) -> Column:
        return F.col(self.name)

    def diff(self, name: str) -> Expr:
        return ONE if name == self.name else ZERO

    def labels(self) -> frozenset[str]:
        return frozenset((self.name,))


@dataclass(frozen=True)
class Sum(Expr):
    terms: tuple[Expr, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a + b, (t.column() for t in self.terms))

    def diff(self, name: str) -> Expr:
        return add(*(t.diff(name) for t in self.terms))

    def labels(self) -> frozenset[str]:
        return frozenset().union(*(t.labels() for t in self.terms))


@dataclass(frozen=True)
class Product(Expr):
    factors: tuple[Expr, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a * b, (t.column() for t in self.factors))

    def diff(self, name: str) -> Expr:
        fs = self.factors
        return add(*(mul(*fs[:i], fs[i].diff(name), *fs[i + 1 :]) for i in range(len(fs))))

    def labels(self) -> frozenset[str]:
        return frozenset().union(*(t.labels() for t in self.factors))


@dataclass(frozen=True)
class Power(Expr):
    base: Expr
    n: float

    def column(self) -> Column:
        b = self.base.column()
        return F.lit(1.0) / b if self.n == -1 else b * b if self.n == 2 else F.pow(b, F.lit(self.n))

    def diff(self, name: str) -> Expr:
        return mul(Const(self.n), power(self.base, self.n - 1), self.base.diff(name))

    def labels(self) -> frozenset[str]:
        return self.base.labels()


#: Spark function and derivative of each elementary function.
FUNCTIONS = {
    "sin": (F.sin, lambda u: call("cos", u)),
    "cos": (F.cos, lambda u: -call("sin", u)),
    "exp": (F.exp, lambda u: call("exp", u)),
    "ln": (F.ln, lambda u: power(u, -1.0)),
    "tanh": (F.tanh, lambda u: 1.0 - call("tanh", u) ** 2),
    "sinh": (F.sinh, lambda u: call("cosh", u)),
    "cosh": (F.cosh, lambda u: call("sinh", u)),
    "asin": (F.asin, lambda u: power(1.0 - u**2, -0.5)),
    "acos": (F.acos, lambda u: -power(1.0 - u**2, -0.5)),
    "atan": (F.atan, lambda u: power(1.0 + u**2, -1.0)),
    "abs": (F.abs, lambda u: call("sign", u)),
    "sign": (F.signum, lambda u: ZERO),
    "floor": (F.floor, lambda u: ZERO),
    "sigmoid": (lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-c)), lambda u: call("sigmoid", u) * (1.0 - call("sigmoid", u))),
}


@dataclass(frozen=True)
class Call(Expr):
    name: str
    arg: Expr

    def column(self) -> Column:
        return FUNCTIONS[self.name][0](self.arg.column())

    def diff(self, name: str) -> Expr:
        return mul(FUNCTIONS[self.name][1](self.arg), self.arg.diff(name))

    def labels(self) -> frozenset[str]:
        return self.arg.labels()


@dataclass(frozen=True)
class Angle(Expr):
    """atan2(y, x)."""

    y: Expr
    x: Expr

    def column(self) -> Column:
        return F.atan2(self.y.column(), self.x.column())

    def diff(self, name: str) -> Expr:
        return (self.x * self.y.diff(name) - self.y * self.x.diff(name)) / (self.x**2 + self.y**2)

    def labels(self) -> frozenset[str]:
        return self.x.labels() | self.y.labels()


#: Comparisons that choose between two expressions.
COMPARISONS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}


@dataclass(frozen=True)
class Choice(Expr):
    """`then` where the comparison of left and right holds, else `other`; differentiated piece by piece."""

    left: Expr
    sign: str
    right: Expr
    then: Expr
    other: Expr

    def column(self) -> Column:
        return F.when(COMPARISONS[self.sign](self.left.column(), self.right.column()), self.then.column()).otherwise(self.other.column())

    def diff(self, name: str) -> Expr:
        return Choice(self.left, self.sign, self.right, self.then.diff(name), self.other.diff(name))

    def labels(self) -> frozenset[str]:
        return self.left.labels() | self.right.labels() | self.then.labels() | self.other.labels()


@dataclass(frozen=True)
class Hooked(Expr):
    """An expression whose derivatives by some names are given; by the others they are its own."""

    of: Expr
    rules: tuple[tuple[str, Expr], ...]

    def column(self) -> Column:
        return self.of.column()

    def diff(self, name: str) -> Expr:
        return dict(self.rules).get(name) or self.of.diff(name)

    def labels(self) -> frozenset[str]:
        return self.of.labels()


@dataclass(frozen=True)
class Described(Expr):
    """An expression with metadata, which go to the column and are dropped by algebra."""

    of: Expr
    metadata: tuple[tuple[str, str], ...]

    def column(self) -> Column:
        return self.of.column()

    def named(self, name: str) -> Column:
        return self.of.column().alias(name, metadata=dict(self.metadata))

    def diff(self, name: str) -> Expr:
        return self.of.diff(name)

    def labels(self) -> frozenset[str]:
        return self.of.labels()


@dataclass(frozen=True)
class Complex:
    """Real and imaginary parts; as a column a struct of re and im."""

    re: Expr
    im: Expr

    def __add__(self, o):
        o = complex_of(o)
        return Complex(self.re + o.re, self.im + o.im)

    __radd__ = __add__

    def __neg__(self):
        return Complex(-self.re, -self.im)

    def __sub__(self, o):
        return self + -complex_of(o)

    def __rsub__(self, o):
        return complex_of(o) - self

    def __mul__(self, o):
        o = complex_of(o)
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    __rmul__ = __mul__

    def conjugate(self):
        return Complex(self.re, -self.im)

    def square(self) -> Expr:
        """The squared size."""
        return self.re**2 + self.im**2

    def __truediv__(self, o):
        o = complex_of(o)
        return self * o.conjugate() * Complex(power(o.square(), -1.0), ZERO)

    def diff(self, name: str):
        return Complex(self.re.diff(name), self.im.diff(name))

    def column(self) -> Column:
        return F.struct(self.re.column().alias("re"), self.im.column().alias("im"))


def complex_of(x) -> Complex:
    return x if isinstance(x, Complex) else Complex(Const(x.real), Const(x.imag)) if isinstance(x, complex) else Complex(lift(x), ZERO)


def turn(angle) -> Complex:
    """exp(i angle)."""
    return Complex(call("cos", angle), call("sin", angle))


ZERO, ONE = Const(0.0), Const(1.0)


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Const(float(x))


def add(*terms: Expr) -> Expr:
    flat = [t for x in terms for t in (x.terms if isinstance(x, Sum) else (x,))]
    constant = sum(t.value for t in flat if isinstance(t, Const))
    rest = [t for t in flat if not isinstance(t, Const)]
    rest += [Const(constant)] if constant or not rest else []
    return rest[0] if len(rest) == 1 else Sum(tuple(rest))


def mul(*factors: Expr) -> Expr:
    flat = [t for x in factors for t in (x.factors if isinstance(x, Product) else (x,))]
    constant = 1.0
    for t in flat:
        constant *= t.value if isinstance(t, Const) else 1.0
    rest = [t for t in flat if not isinstance(t, Const)]
    if constant == 0 or not rest:
        return Const(constant)
    rest = ([Const(constant)] if constant != 1 else []) + rest
    return rest[0] if len(rest) == 1 else Product(tuple(rest))


def power(base: Expr, n: float) -> Expr:
    if n == 0:
        return ONE
    if isinstance(base, Const):
        return Const(base.value**n)
    if n == 1:
        return base
    return Power(base.base, base.n * n) if isinstance(base, Power) and float(n).is_integer() and float(base.n).is_integer() else Power(base, n)


def call(name: str, arg) -> Expr:
    return Call(name, lift(arg))


def sin(x) -> Expr:
    return call("sin", x)


def cos(x) -> Expr:
    return call("cos", x)


def exp(x) -> Expr:
    return call("exp", x)


def ln(x) -> Expr:
    return call("ln", x)


def tanh(x) -> Expr:
    return call("tanh", x)


def sqrt(x) -> Expr:
    return power(lift(x), 0.5)


def absolute(x) -> Expr:
    return call("abs", x)


def sinh(x) -> Expr:
    return call("sinh", x)


def cosh(x) -> Expr:
    return call("cosh", x)


def atan2(y, x) -> Expr:
    return Angle(lift(y), lift(x))


def where(left, sign: str, right, then, other) -> Expr:
    return Choice(lift(left), sign, lift(right), lift(then), lift(other))


def maximum(a, b) -> Expr:
    return where(a, ">=", b, a, b)


def minimum(a, b) -> Expr:
    return where(a, "<=", b, a, b)


def with_derivatives(u: Expr, rules: dict[str, Expr]) -> Expr:
    return Hooked(u, tuple(rules.items()))


def derivative_rules(u: Expr) -> dict[str, Expr]:
    return dict(u.rules) if isinstance(u, Hooked) else {}


def with_metadata(u: Expr, **metadata: str) -> Described:
    known = dict(u.metadata) if isinstance(u, Described) else {}
    return Described(u.of if isinstance(u, Described) else u, tuple({**known, **metadata}.items()))


def function(*labels: str):
    """Decorates a function of expressions: the field it makes of these labels."""
    return lambda f: lift(f(*(Label(n) for n in labels)))
