"""Differential operators on fields, exact by symbolic derivatives.

Vectors and matrices are lists of expressions; `names` are the columns of the space.
"""

from __future__ import annotations

from collections.abc import Sequence

from axisfield.functions.expressions import ONE, ZERO, Expr, add, lift, ln, mul, power, sqrt

Vector = list[Expr]
Matrix = list[list[Expr]]


def partial(u: Expr, name: str, order: int = 1) -> Expr:
    for _ in range(order):
        u = u.diff(name)
    return u


def grad(u: Expr, names: Sequence[str]) -> Vector:
    return [u.diff(n) for n in names]


def jacobian(v: Vector, names: Sequence[str]) -> Matrix:
    return [grad(c, names) for c in v]


def hessian(u: Expr, names: Sequence[str]) -> Matrix:
    return jacobian(grad(u, names), names)


def dot(a: Vector, b: Vector) -> Expr:
    return add(*(mul(lift(x), lift(y)) for x, y in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def directional_derivative(u: Expr, v: Vector, names: Sequence[str]) -> Expr:
    return dot(grad(u, names), v)


def div(v: Vector, names: Sequence[str]) -> Expr:
    if len(v) != len(names):
        raise ValueError("a divergence needs as many components as columns")
    return add(*(c.diff(n) for c, n in zip(v, names, strict=True)))


def div_tensor(t: Matrix, names: Sequence[str]) -> Vector:
    """(div T)_j = sum_i d_i T_ij."""
    return [add(*(t[i][j].diff(n) for i, n in enumerate(names))) for j in range(len(names))]


def curl(v: Vector, names: Sequence[str]) -> Vector:
    if len(v) != 3 or len(names) != 3:
        raise ValueError("curl is of three dimensions")
    x, y, z = names
    return [v[2].diff(y) - v[1].diff(z), v[0].diff(z) - v[2].diff(x), v[1].diff(x) - v[0].diff(y)]


def laplacian(u: Expr, names: Sequence[str]) -> Expr:
    return add(*(partial(u, n, 2) for n in names))


def bilaplacian(u: Expr, names: Sequence[str]) -> Expr:
    return laplacian(laplacian(u, names), names)


def material_derivative(u: Expr, v: Vector, names: Sequence[str], time: str = "t") -> Expr:
    return u.diff(time) + directional_derivative(u, v, names)


def div_k_grad(u: Expr, k: Expr, names: Sequence[str]) -> Expr:
    return dot(grad(k, names), grad(u, names)) + k * laplacian(u, names)


def div_diag_k_grad(u: Expr, k: Vector, names: Sequence[str]) -> Expr:
    return add(*(ki.diff(n) * u.diff(n) + ki * partial(u, n, 2) for ki, n in zip(k, names, strict=True)))


def div_tensor_k_grad(u: Expr, k: Matrix, names: Sequence[str]) -> Expr:
    return div(matvec(k, grad(u, names)), names)


def identity(d: int) -> Matrix:
    return [[ONE if i == j else ZERO for j in range(d)] for i in range(d)]


def matvec(m: Matrix, v: Vector) -> Vector:
    return [dot(row, v) for row in m]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [[dot(row, [r[j] for r in b]) for j in range(len(b[0]))] for row in a]


def transpose(m: Matrix) -> Matrix:
    return [list(c) for c in zip(*m, strict=True)]


def combine(*parts: tuple[float | Expr, Matrix]) -> Matrix:
    """The sum of scaled matrices."""
    d, e = len(parts[0][1]), len(parts[0][1][0])
    return [[add(*(mul(lift(s), m[i][j]) for s, m in parts)) for j in range(e)] for i in range(d)]


def trace(m: Matrix) -> Expr:
    return add(*(m[i][i] for i in range(len(m))))


def det(m: Matrix) -> Expr:
    if len(m) == 1:
        return m[0][0]
    return add(*(mul(lift((-1.0) ** j), m[0][j], det([[*r[:j], *r[j + 1 :]] for r in m[1:]])) for j in range(len(m))))


def inverse(m: Matrix) -> Matrix:
    d = len(m)
    over = power(det(m), -1.0)
    minor = lambda i, j: [[*r[:j], *r[j + 1 :]] for k, r in enumerate(m) if k != i]
    return [[mul(lift((-1.0) ** (i + j)), det(minor(j, i)) if d > 1 else ONE, over) for j in range(d)] for i in range(d)]


def norm(v: Vector, order: float = 2.0) -> Expr:
    if order == 2:
        return sqrt(dot(v, v))
    return power(add(*(power(power(c, 2.0), order / 2) for c in v)), 1 / order)


# continuum mechanics


def strain(u: Vector, names: Sequence[str]) -> Matrix:
    j = jacobian(u, names)
    return combine((0.5, j), (0.5, transpose(j)))


def strain_rate_magnitude(u: Vector, names: Sequence[str]) -> Expr:
    d = strain(u, names)
    return sqrt(2.0 * add(*(mul(x, x) for row in d for x in row)))


def elastic_stress(u: Vector, lame: float, mu: float, names: Sequence[str]) -> Matrix:
    e = strain(u, names)
    return combine((2 * mu, e), (lame * trace(e), identity(len(names))))


def viscous_stress(u: Vector, mu: float, names: Sequence[str], lame: float | None = None) -> Matrix:
    return elastic_stress(u, -2 * mu / 3 if lame is None else lame, mu, names)


def flow_stress(u: Vector, p: Expr, mu: float, names: Sequence[str]) -> Matrix:
    return combine((1.0, viscous_stress(u, mu, names)), (-lift(p), identity(len(names))))


def deformation_gradient(u: Vector, names: Sequence[str]) -> Matrix:
    return combine((1.0, identity(len(names))), (1.0, jacobian(u, names)))


def finite_strain(u: Vector, names: Sequence[str]) -> Matrix:
    f = deformation_gradient(u, names)
    return combine((0.5, matmul(transpose(f), f)), (-0.5, identity(len(names))))


def second_stress(u: Vector, lame: float, mu: float, names: Sequence[str]) -> Matrix:
    e = finite_strain(u, names)
    return combine((2 * mu, e), (lame * trace(e), identity(len(names))))


def first_stress(u: Vector, s: Matrix, names: Sequence[str]) -> Matrix:
    return matmul(deformation_gradient(u, names), s)


def true_stress(u: Vector, s: Matrix, names: Sequence[str]) -> Matrix:
    f = deformation_gradient(u, names)
    return combine((power(det(f), -1.0), matmul(matmul(f, s), transpose(f))))


def neo_hookean_first(u: Vector, mu: float, kappa: float, names: Sequence[str]) -> Matrix:
    f = deformation_gradient(u, names)
    back = transpose(inverse(f))
    return combine((mu, f), (-mu, back), (kappa * ln(det(f)), back))


def neo_hookean_true(u: Vector, mu: float, kappa: float, names: Sequence[str]) -> Matrix:
    f, d = deformation_gradient(u, names), len(names)
    j = det(f)
    return combine((mu / j, matmul(f, transpose(f))), (-mu / j, identity(d)), (kappa * ln(j) / j, identity(d)))


def deviatoric(s: Matrix) -> Matrix:
    return combine((1.0, s), (-trace(s) / len(s), identity(len(s))))


def pressure(s: Matrix) -> Expr:
    return -trace(s) / len(s)


def von_mises(s: Matrix) -> Expr:
    if len(s) == 2:
        return sqrt(s[0][0] ** 2 - s[0][0] * s[1][1] + s[1][1] ** 2 + 3.0 * s[0][1] ** 2)
    d = deviatoric(s)
    return sqrt(1.5 * add(*(mul(x, x) for row in d for x in row)))


def maxwell_stress(e: Vector, h: Vector, epsilon: float, mu: float) -> Matrix:
    d = len(e)
    outer = lambda v: [[a * b for b in v] for a in v]
    return combine((epsilon, outer(e)), (-0.5 * epsilon * dot(e, e), identity(d)), (mu, outer(h)), (-0.5 * mu * dot(h, h), identity(d)))


# surfaces with unit normal n


def tangential(w: Vector, n: Vector) -> Vector:
    along = dot(w, n)
    return [a - along * b for a, b in zip(w, n, strict=True)]


def projector(n: Vector) -> Matrix:
    return combine((1.0, identity(len(n))), (-1.0, [[a * b for b in n] for a in n]))


def surface_grad(u: Expr, n: Vector, names: Sequence[str]) -> Vector:
    return tangential(grad(u, names), n)


def surface_div(v: Vector, n: Vector, names: Sequence[str]) -> Expr:
    return trace(matmul(projector(n), jacobian(v, names)))


def surface_curl(v: Vector, n: Vector, names: Sequence[str]) -> Expr:
    return dot(n, curl(v, names))


def laplace_beltrami(u: Expr, n: Vector, names: Sequence[str]) -> Expr:
    p = projector(n)
    return trace(matmul(matmul(p, hessian(u, names)), p))


def surface_curl_vector(v: Vector, n: Vector, names: Sequence[str]) -> Expr:
    """The normal part of the curl of a vector field."""
    return surface_curl(v, n, names)


def surface_curl_scalar(u: Expr, n: Vector, names: Sequence[str]) -> Vector:
    """The surface gradient turned by a right angle: n x grad u."""
    return cross(n, surface_grad(u, n, names))


def laplace_beltrami_divgrad(u: Expr, n: Vector, names: Sequence[str]) -> Expr:
    """The surface divergence of the surface gradient: with a normal that varies it counts the curvature."""
    return surface_div(surface_grad(u, n, names), n, names)


def elastic_stress_2d(u: Vector, young: float, poisson: float, names: Sequence[str], plane: str = "stress") -> Matrix:
    """Isotropic stress in the plane, without stress (plane = stress) or strain (strain) across it."""
    e = strain(u, names)
    if plane == "stress":
        along, across = young / (1 - poisson**2), young * poisson / (1 - poisson**2)
    elif plane == "strain":
        c = young / ((1 + poisson) * (1 - 2 * poisson))
        along, across = c * (1 - poisson), c * poisson
    else:
        raise ValueError("plane is stress or strain")
    shear = e[0][1] * (young / (1 + poisson))
    return [[e[0][0] * along + e[1][1] * across, shear], [shear, e[0][0] * across + e[1][1] * along]]


def orthotropic_stress_2d(u: Vector, young1, young2, poisson12, shear12, names: Sequence[str]) -> Matrix:
    """Stress of a material with two axes in the plane; its stiffness there is the inverse of the compliance of both
    directions, for plane stress and plane strain alike. Moduli are numbers or fields."""
    e = strain(u, names)
    e1, e2, nu, g = (lift(x) for x in (young1, young2, poisson12, shear12))
    scale = power(1.0 - nu * nu * e2 / e1, -1.0)
    cross_term = nu * e2 * scale
    shear = 2.0 * e[0][1] * g
    return [[e[0][0] * e1 * scale + e[1][1] * cross_term, shear], [shear, e[0][0] * cross_term + e[1][1] * e2 * scale]]


def einsum(subscripts: str, *operands):
    """A contraction of nested lists of expressions, written as in numpy; `...` stands for the axes not named."""
    def shape(x) -> list[int]:
        return [len(x), *shape(x[0])] if isinstance(x, list) else []

    given, _, result = subscripts.replace(" ", "").partition("->")
    terms = given.split(",")
    if len(terms) != len(operands):
        raise ValueError("as many subscripts as operands are needed")
    sizes: dict[str, int] = {}
    expanded = []
    for term, x in zip(terms, operands, strict=True):
        own = shape(x)
        if "..." in term:
            more = len(own) - len(term.replace("...", ""))
            term = term.replace("...", "".join(chr(0x3B1 + k) for k in range(more)))
        if len(term) != len(own):
            raise ValueError("subscripts do not fit an operand")
        for letter, size in zip(term, own, strict=True):
            if sizes.setdefault(letter, size) != size:
                raise ValueError("axes of one letter differ in size")
        expanded.append(term)
    letters = sorted(sizes)
    greek = "".join(x for x in letters if x >= chr(0x3B1))
    if "->" in subscripts:
        result = result.replace("...", greek)
    else:
        result = greek + "".join(x for x in letters if "".join(expanded).count(x) == 1 and x not in greek)
    summed = [x for x in letters if x not in result]

    def pick(x, term: str, at: dict[str, int]):
        for letter in term:
            x = x[at[letter]]
        return lift(x)

    def total(at: dict[str, int], left: list[str]) -> Expr:
        if left:
            return add(*(total({**at, left[0]: k}, left[1:]) for k in range(sizes[left[0]])))
        return mul(*(pick(x, t, at) for x, t in zip(operands, expanded, strict=True)))

    def build(at: dict[str, int], left: str):
        return [build({**at, left[0]: k}, left[1:]) for k in range(sizes[left[0]])] if left else total(at, summed)

    return build({}, result)
