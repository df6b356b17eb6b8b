"""The normal distribution as SQL text, which F.expr() takes, so that it stays inside generated code."""

from __future__ import annotations

# The coefficients of Wichura's algorithm AS 241 (1988) for the inverse, constant term first.
PPF_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
PPF_NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
PPF_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# The coefficients of Cody's rational approximations (1969) for the distribution, constant term first.
CDF_MIDDLE = (
    (18154.981253343561249, 1067.6894854603709582, 161.02823106855587881, 2.2352520354606839287, 0.065682337918207449113),
    (45507.789335026729956, 10260.932208618978205, 976.09855173777669322, 47.20258190468824187, 1.0),
)
CDF_NEAR = (
    (9842.7148383839780218, 11602.651437647350124, 6848.1904505362823326, 2494.5375852903726711, 597.27027639480026226, 93.506656132177855979, 8.8831497943883759412, 0.39894151208813466764, 1.0765576773720192317e-8),
    (19685.429676859990727, 38912.003286093271411, 34900.952721145977266, 18615.571640885098091, 6485.558298266760755, 1519.377599407554805, 235.38790178262499861, 22.266688044328115691, 1.0),
)
CDF_FAR = (
    (2.9112874951168792e-5, 0.001421619193227893466, 0.022235277870649807, 0.1274011611602473639, 0.21589853405795699, 0.02307344176494017303),
    (7.29751555083966205e-5, 0.00378239633202758244, 0.0659881378689285515, 0.468238212480865118, 1.28426009614491121, 1.0),
)
ROOT_TWO_PI = 2.5066282746310002


def _number(c: float) -> str:
    return f"CAST('{c!r}' AS DOUBLE)"


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = _number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {_number(c)})"
    return out


def _ratio(pair: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    return f"({_polynomial(pair[0], x)} / {_polynomial(pair[1], x)})"


def ppf(p: str) -> str:
    """The normal quantile of an SQL expression, to double precision; null outside of (0, 1)."""
    q = f"(({p}) - 0.5D)".replace("0.5D", _number(0.5))
    square = f"({_number(0.180625)} - {q} * {q})"
    tail = f"sqrt(-ln(least(({p}), {_number(1.0)} - ({p}))))"
    near, far = _ratio(PPF_NEAR, f"({tail} - {_number(1.6)})"), _ratio(PPF_FAR, f"({tail} - {_number(5.0)})")
    outer = f"(CASE WHEN {tail} <= {_number(5.0)} THEN {near} ELSE {far} END * sign({q}))"
    return f"(CASE WHEN ({p}) > 0 AND ({p}) < 1 THEN CASE WHEN abs({q}) <= {_number(0.425)} THEN {q} * {_ratio(PPF_MIDDLE, square)} ELSE {outer} END END)"


def cdf(x: str) -> str:
    """The normal distribution function of an SQL expression."""
    y = f"abs({x})"
    square = f"(({x}) * ({x}))"
    middle = f"({_number(0.5)} + ({x}) * {_ratio(CDF_MIDDLE, square)})"
    inverse = f"({_number(1.0)} / {square})"
    density = f"exp({_number(-0.5)} * {square})"
    near = f"({density} * {_ratio(CDF_NEAR, y)})"
    far = f"({density} * (({_number(1 / ROOT_TWO_PI)} - {inverse} * {_ratio(CDF_FAR, inverse)}) / {y}))"
    tail = f"(CASE WHEN {y} <= sqrt({_number(32.0)}) THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {y} <= {_number(0.67448975)} THEN {middle} WHEN ({x}) > 0 THEN {_number(1.0)} - {tail} ELSE {tail} END)"
