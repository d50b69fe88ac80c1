"""Learned fields as staged expressions.

A network is a list of stages. Each stage names columns and gives them as expressions over those of the stages before and
over parameters, which are labels too. Evaluation is one projection a stage, in whole-stage code generation;
a hidden unit is computed once however often it is used. The gradient of a sum in all parameters is the same
backwards: one projection of adjoints a stage, and one aggregation. Nothing runs in Python.

Parameters have a start value by name; a fitted network is `bound` to its values. `expression` writes a small
network out as one expression, so that differential operators and constraints take it like any field.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.functions.expressions import Angle, Call, Choice, Complex, Const, Expr, Label, Power, Product, Sum, add, call, lift, mul, power, tanh, turn

Activation = Callable[[Expr], Expr]


def substitute(u: Expr, values: dict[str, Expr]) -> Expr:
    """Labels replaced by expressions."""
    go = lambda x: substitute(x, values)
    match u:
        case Label(name):
            return values.get(name, u)
        case Sum(terms):
            return add(*map(go, terms))
        case Product(factors):
            return mul(*map(go, factors))
        case Power(base, n):
            return power(go(base), n)
        case Call(name, arg):
            return call(name, go(arg))
        case Angle(y, x):
            return Angle(go(y), go(x))
        case Choice(left, sign, right, then, other):
            return Choice(go(left), sign, go(right), go(then), go(other))
        case Const():
            return u
    raise TypeError(f"no substitution in {type(u).__name__}")


@dataclass(frozen=True)
class Network:
    """inputs: labels; stages: columns by name, in order; outputs: their names; start: the parameters' values."""

    inputs: tuple[str, ...]
    stages: tuple[dict[str, Expr], ...]
    outputs: tuple[str, ...]
    start: dict[str, float]

    def bound(self, values: dict[str, float]) -> Network:
        return replace(self, start={**self.start, **values})

    def _staged(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({k: F.lit(float(v)) for k, v in self.start.items()})
        for stage in self.stages:
            out = out.withColumns({k: e.column() for k, e in stage.items()})
        return out

    def evaluate(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """The rows with the outputs as columns (under `names`)."""
        out = self._staged(df)
        return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(o).alias(n) for o, n in zip(self.outputs, names or self.outputs, strict=True)))

    def expression(self) -> list[Expr]:
        """The outputs written out over the inputs, with the parameters' values."""
        known: dict[str, Expr] = {k: Const(float(v)) for k, v in self.start.items()}
        for stage in self.stages:
            known |= {k: substitute(e, known) for k, e in stage.items()}
        return [known[o] for o in self.outputs]

    def value_and_slope(self, df: DataFrame, loss: Expr, weight: Column | None = None) -> tuple[float, dict[str, float]]:
        """The mean of a loss (an expression over outputs and columns of the rows) and its slope in every parameter, in one pass."""
        out = self._staged(df)
        # users of a column: expressions of later stages and the loss, each with its adjoint
        users: list[tuple[Expr, Column]] = [(loss, F.lit(1.0))]
        for stage in reversed(self.stages):
            adjoints = {}
            for name in stage:
                parts = [adjoint * e.diff(name).column() for e, adjoint in users if name in e.labels()]
                adjoints[f"__adjoint_{name}"] = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
            out = out.withColumns(adjoints)
            users += [(e, F.col(f"__adjoint_{name}")) for name, e in stage.items()]
        slopes: dict[str, list[Column]] = {p: [] for p in self.start}
        for e, adjoint in users:
            for p in e.labels() & slopes.keys():
                slopes[p].append(adjoint * e.diff(p).column())
        w = F.lit(1.0) if weight is None else weight
        row = out.agg(F.avg(loss.column() * w), *(F.avg(sum(parts, F.lit(0.0)) * w) for parts in slopes.values())).first()
        return float(row[0]), dict(zip(slopes, map(float, row[1:]), strict=True))


class Builder:
    """Stages and parameters of a network under a name; parameters are named theta_<name>_<number>."""

    def __init__(self, name: str, inputs: Sequence[str], seed: int = 0):
        self.name, self.inputs, self.stages, self.start = name, tuple(inputs), [], {}
        self.draw = random.Random(f"{name}/{seed}")

    def parameter(self, value: float) -> Expr:
        label = f"theta_{self.name}_{len(self.start)}"
        self.start[label] = float(value)
        return Label(label)

    def stage(self, units: Sequence[Expr]) -> list[Expr]:
        names = [f"{self.name}_{len(self.stages)}_{k}" for k in range(len(units))]
        self.stages.append(dict(zip(names, units, strict=True)))
        return [Label(n) for n in names]

    def network(self, outputs: Sequence[Expr]) -> Network:
        names = [o.name for o in (outputs if all(isinstance(o, Label) for o in outputs) else self.stage(list(outputs)))]
        return Network(self.inputs, tuple(self.stages), tuple(names), dict(self.start))

    # layers: lists of expressions to lists of expressions

    def linear(self, x: Sequence[Expr], out: int, activation: Activation | None = None, bias: bool = True, positive: bool = False, factored: bool = False) -> list[Expr]:
        """phi(W x + b); positive weights are exp(w), factored ones exp(s) v with one s a unit."""
        bound, units = math.sqrt(6 / (len(x) + out)), []
        for _ in range(out):
            scale = call("exp", self.parameter(0.0)) if factored else None
            ws = [self.parameter(self.draw.uniform(-bound, bound)) for _ in x]
            ws = [call("exp", w) for w in ws] if positive else ws
            z = add(*(w * v for w, v in zip(ws, x, strict=True)))
            z = scale * z if scale is not None else z
            units.append(z + self.parameter(0.0) if bias else z)
        units = self.stage(units)
        return self.stage([activation(u) for u in units]) if activation else units

    def dense(self, x: Sequence[Expr], out: int, hidden: Sequence[int], activation: Activation = tanh, skip: bool = False) -> list[Expr]:
        """A multi-layer network; `skip` adds a layer's input where the sizes are equal."""
        h = list(x)
        for width in hidden:
            y = self.linear(h, width, activation)
            h = self.stage([a + b for a, b in zip(y, h, strict=True)]) if skip and len(h) == width else y
        return self.linear(h, out)

    def polynomial(self, x: Sequence[Expr], out: int, degree: int, family: str = "chebyshev", squash: bool = True) -> list[Expr]:
        """Sums over inputs of polynomials of each input: a layer of edge functions."""
        t = self.stage([tanh(v) for v in x]) if squash else list(x)
        basis = [self.stage(polynomials(v, degree, family)) for v in t]
        scale = 1 / (len(x) * (degree + 1))
        return self.stage([add(*(self.parameter(self.draw.gauss(0, scale)) * p for b in basis for p in b)) for _ in range(out)])

    def edges(self, x: Sequence[Expr], out: int, hidden: Sequence[int], degree: int | Sequence[int] = 3, family: str = "chebyshev") -> list[Expr]:
        """A stack of polynomial layers, each with its degree."""
        sizes = [*hidden, out]
        degrees = [degree] * len(sizes) if isinstance(degree, int) else list(degree)
        h = list(x)
        for size, d in zip(sizes, degrees, strict=True):
            h = self.polynomial(h, size, d, family)
        return h

    def fourier(self, x: Sequence[Expr], features: int, mean: float = 0.0, deviation: float = 1.0, trainable: bool = False) -> list[Expr]:
        """cos(B x) and sin(B x) with random rows of B."""
        waves = []
        for _ in range(features):
            row = [self.draw.gauss(mean, deviation) for _ in x]
            waves.append(add(*((self.parameter(b) if trainable else Const(b)) * v for b, v in zip(row, x, strict=True))))
        waves = self.stage(waves)
        return self.stage([call(f, w) for f in ("cos", "sin") for w in waves])

    def adaptive(self, x: Sequence[Expr], f: Activation = tanh) -> list[Expr]:
        """f(a x) with one a for the layer."""
        a = self.parameter(1.0)
        return self.stage([f(a * v) for v in x])

    def stan(self, x: Sequence[Expr]) -> list[Expr]:
        """tanh(x) (1 + b x), one b a unit."""
        return self.stage([tanh(v) * (1.0 + self.parameter(1.0) * v) for v in x])

    def paths(self, x: Sequence[Expr], width: int, depth: int, count: int, out: int) -> list[Expr]:
        """Sums over paths of turned complex maps: z -> D * soft(sum of weights_k exp(i a_k(z)) (W_k z + b_k)), read out linearly."""
        real = self.linear(x, width)
        imag = self.linear(x, width)
        for _ in range(depth):
            z = [Complex(a, b) for a, b in zip(real, imag, strict=True)]
            logits = [self.parameter(0.0) for _ in range(count)]
            shares = self.stage([call("exp", v) for v in logits])
            total = self.stage([add(*shares)])[0]
            phases = [self.linear([*real, *imag], 1)[0] for _ in range(count)]
            units = []
            for _ in range(width):
                sums = Complex(Const(0.0), Const(0.0))
                for k in range(count):
                    weights = [Complex(self.parameter(self.draw.gauss(0, 0.5 / math.sqrt(width))), self.parameter(self.draw.gauss(0, 0.5 / math.sqrt(width)))) for _ in range(width)]
                    inner = Complex(self.parameter(0.0), self.parameter(0.0))
                    for w, v in zip(weights, z, strict=True):
                        inner = inner + w * v
                    sums = sums + turn(phases[k]) * inner * (shares[k] / total)
                units.append(sums)
            flat = self.stage([part for u in units for part in (u.re, u.im)])
            sizes = self.stage([power(flat[2 * k] ** 2 + flat[2 * k + 1] ** 2 + 1e-12, 0.5) for k in range(width)])
            # a soft threshold on the size keeps the angle
            gains = self.stage([call("sigmoid", s + self.parameter(0.0)) for s in sizes])
            both = self.stage([flat[2 * k + j] * gains[k] for j in range(2) for k in range(width)])
            real, imag = both[:width], both[width:]
        return self.linear([*real, *imag], out)


def polynomials(t: Expr, degree: int, family: str) -> list[Expr]:
    """Orders 0..degree of a family, each written out by its recurrence."""
    steps = {
        "chebyshev": (t, lambda k, a, b: 2.0 * t * a - b), "second": (2.0 * t, lambda k, a, b: 2.0 * t * a - b), "legendre": (t, lambda k, a, b: t * a * ((2 * k + 1) / (k + 1)) - b * (k / (k + 1))),
        "hermite": (t, lambda k, a, b: t * a - b * float(k)), "laguerre": (1.0 - t, lambda k, a, b: ((2 * k + 1) - t) * a * (1 / (k + 1)) - b * (k / (k + 1))),
    }
    if family not in steps:
        raise ValueError(f"unknown family {family}")
    first, step = steps[family]
    out = [Const(1.0), first]
    for k in range(1, degree):
        out.append(step(k, out[-1], out[-2]))
    return out[: degree + 1]


def degree_schedule(layers: int, start: int, end: int, strategy: str = "linear") -> list[int]:
    """A degree per layer from start to end: linear, or by equal ratios (geometric)."""
    if layers == 1:
        return [start]
    at = [k / (layers - 1) for k in range(layers)]
    return [round(start + (end - start) * a) if strategy == "linear" else round(start * (end / start) ** a) for a in at]


def high_order_penalty(coefficients: Sequence[Sequence[float]], alpha: float = 1e-4, power_of_order: float = 2.0, since: int = 2) -> float:
    """alpha times the sum of order^power c^2 over the orders from `since` on; one list of coefficients an edge."""
    return alpha * sum(k**power_of_order * c * c for edge in coefficients for k, c in enumerate(edge) if k >= since)


# whole models


def dense(name: str, inputs: Sequence[str], out: int = 1, hidden: Sequence[int] = (8,), seed: int = 0, **options) -> Network:
    b = Builder(name, inputs, seed)
    return b.network(b.dense([Label(x) for x in inputs], out, hidden, **options))


def edge_network(name: str, inputs: Sequence[str], out: int = 1, hidden: Sequence[int] = (4,), degree: int | Sequence[int] = 3, family: str = "chebyshev", seed: int = 0) -> Network:
    b = Builder(name, inputs, seed)
    return b.network(b.edges([Label(x) for x in inputs], out, hidden, degree, family))


def path_network(name: str, inputs: Sequence[str], out: int = 1, width: int = 3, depth: int = 1, count: int = 2, seed: int = 0) -> Network:
    b = Builder(name, inputs, seed)
    return b.network(b.paths([Label(x) for x in inputs], width, depth, count, out))


def separable(name: str, inputs: Sequence[str], out: int = 1, rank: int = 4, factor: Callable[[Builder, Expr, int], list[Expr]] | None = None, seed: int = 0) -> Network:
    """Outputs as sums over ranks of products of one-input models (dense ones of eight units, if none is given)."""
    b = Builder(name, inputs, seed)
    factor = factor or (lambda own, x, n: own.dense([x], n, [8]))
    parts = [factor(b, Label(x), rank * out) for x in inputs]
    return b.network([add(*(mul(*(p[o * rank + r] for p in parts)) for r in range(rank))) for o in range(out)])


def branch_and_trunk(name: str, data: Sequence[str], coordinates: Sequence[str], out: int = 1, latent: int = 4, hidden: Sequence[int] = (8,), seed: int = 0) -> Network:
    """The inner product of a model of the data columns with one of the coordinates."""
    b = Builder(name, [*data, *coordinates], seed)
    branch, trunk = b.dense([Label(x) for x in data], latent * out, hidden), b.dense([Label(x) for x in coordinates], latent, hidden)
    return b.network([add(*(branch[o * latent + k] * trunk[k] for k in range(latent))) for o in range(out)])


def sequential(name: str, first: Network, then: Callable[[Builder, list[Expr]], list[Expr]], seed: int = 0) -> Network:
    """A network whose outputs go on through further layers."""
    b = Builder(name, first.inputs, seed)
    b.stages, b.start = [*first.stages], dict(first.start)
    return b.network(then(b, [Label(o) for o in first.outputs]))


def concatenated(*networks: Network) -> Network:
    """The outputs of several networks of different names, side by side."""
    depth = max(len(n.stages) for n in networks)
    stages = tuple({k: e for n in networks if d < len(n.stages) for k, e in n.stages[d].items()} for d in range(depth))
    inputs = tuple(dict.fromkeys(x for n in networks for x in n.inputs))
    return Network(inputs, stages, tuple(o for n in networks for o in n.outputs), {k: v for n in networks for k, v in n.start.items()})


def magnitude_direction(size: Network, direction: Network) -> Network:
    """size * direction / |direction| (a direction of length zero counts as of length one)."""
    both = concatenated(size, direction)
    d = [Label(o) for o in direction.outputs]
    length, stage = f"{direction.outputs[0]}_length", add(*(v**2 for v in d))
    safe = Choice(stage, ">", Const(0.0), power(stage, 0.5), Const(1.0))
    names = [f"{o}_unit" for o in direction.outputs]
    last = {n: Label(size.outputs[0]) * v / Label(length) for n, v in zip(names, d, strict=True)}
    return Network(both.inputs, (*both.stages, {length: safe}, last), tuple(names), both.start)


def complex_output(network: Network) -> list[Column]:
    """Pairs of outputs (all real parts, then all imaginary ones) as structs."""
    half = len(network.outputs) // 2
    return [F.struct(F.col(a).alias("re"), F.col(b).alias("im")) for a, b in zip(network.outputs[:half], network.outputs[half:], strict=True)]


def parameter_field(value: float, name: str, transform: Activation | None = None) -> Network:
    """A trainable constant."""
    b = Builder(name, [])
    p = b.parameter(value)
    return b.network(b.stage([transform(p) if transform else lift(p)]))
