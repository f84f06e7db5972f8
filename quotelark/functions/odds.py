"""Column expressions on decimal odds, probabilities and stakes. All are native: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied(odds: Column) -> Column:
    return F.when(odds > 1, 1 / odds)


def overround(odds: Column) -> Column:
    """Margin of an array of odds: sum of 1 / o, less 1."""
    return F.aggregate(odds, F.lit(0.0), lambda s, o: s + 1 / o) - 1


def net_odds(odds: Column, commission: Column) -> Column:
    """Odds after commission on the winnings."""
    return 1 + (odds - 1) * (1 - commission)


def net_ev(p: Column, odds: Column, commission: Column) -> Column:
    return p * (odds - 1) * (1 - commission) - (1 - p)


def break_even(odds: Column, commission: Column) -> Column:
    return 1 / net_odds(odds, commission)


def minimum_odds(p: Column, commission: Column) -> Column:
    """The least odds, rounded up to two places, that break even at p."""
    return F.ceil((1 + (1 / p - 1) / (1 - commission)) * 100) / 100


def american_to_decimal(line: Column) -> Column:
    return F.when(line > 0, 1 + line / 100).when(line < 0, 1 + 100 / F.abs(line))


def kelly(p: Column, odds: Column, commission: Column) -> Column:
    """The growth-optimal share of the bank, at least 0."""
    gain = net_odds(odds, commission) - 1
    return F.greatest(F.lit(0.0), (p * gain - (1 - p)) / gain)


def stake(policy: str, bank: Column, p: Column, odds: Column, commission: Column, share: float = 0.01, fraction: float = 0.25, cap: float = 0.02, least: float = 1.0) -> Column:
    """fixed: share of the bank; kelly: a fraction of Kelly, capped. Under the least stake nothing is staked."""
    raw = bank * share if policy == "fixed" else bank * F.least(kelly(p, odds, commission) * fraction, F.lit(cap))
    return F.when(raw >= least, F.round(raw, 2)).otherwise(0.0)


def pnl(status: Column, odds: Column, commission: Column, staked: Column) -> Column:
    return F.when(status == "WON", staked * (odds - 1) * (1 - commission)).when(status == "LOST", -staked).when(status == "VOID", 0.0)


def outcome(market: Column, selection: Column, home: Column, away: Column, line: Column) -> Column:
    """WON, LOST or VOID of a selection; an unknown market is an error."""
    won = lambda c: F.when(c, "WON").otherwise("LOST")
    total = home + away
    return (
        F.when(market == "1X2", won(F.when(selection == "home", home > away).when(selection == "away", home < away).otherwise(home == away)))
        .when(market == "DC", won(F.when(selection == "1X", home >= away).when(selection == "X2", home <= away).otherwise(home != away)))
        .when(market == "OU", F.when(total == line, "VOID").otherwise(won((total > line) == (selection == "over"))))
        .when(market == "BTTS", won(((home > 0) & (away > 0)) == (selection == "yes")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown market: "), market)).cast("string"))
    )


def asian_handicap(margin: Column, line: Column) -> Column:
    """Share of the stake returned as a win to the home side: 1, 0 or 1/2; a quarter line is the mean of its neighbours."""

    def whole(at: Column) -> Column:
        return F.when(margin + at > 0, 1.0).when(margin + at < 0, 0.0).otherwise(0.5)

    quarter = F.pmod(line * 4, F.lit(2)) == 1
    return F.when(quarter, (whole(line - 0.25) + whole(line + 0.25)) / 2).otherwise(whole(line))


def elo_expected(edge: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -edge / 400))


def three_way(home: Column, away: Column, advantage: float, draw: float) -> Column:
    """Home, draw and away chances from two ratings and a draw margin."""
    edge = home - away + advantage
    win, lose = elo_expected(edge - draw), 1 - elo_expected(edge + draw)
    return F.struct(win.alias("home"), (1 - win - lose).alias("draw"), lose.alias("away"))


def poisson_pmf(rate: Column, most: int) -> Column:
    """Chances of 0..most goals as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.exp(-rate) * F.pow(rate, k.cast("double")) / F.factorial(k))


def goal_grid(home: Column, away: Column, most: int) -> Column:
    """Home, draw and away chances of two independent Poisson counts up to `most`, scaled to sum 1; one pass, no grid of cells."""
    a, b = poisson_pmf(home, most), poisson_pmf(away, most)
    start = F.struct(*[F.lit(0.0).alias(x) for x in ("ca", "cb", "home", "draw", "away")])

    def add(s: Column, z: Column) -> Column:
        return F.struct(
            (s["ca"] + z["a"]).alias("ca"), (s["cb"] + z["b"]).alias("cb"), (s["home"] + z["a"] * s["cb"]).alias("home"),
            (s["draw"] + z["a"] * z["b"]).alias("draw"), (s["away"] + z["b"] * s["ca"]).alias("away"),
        )

    def scaled(s: Column) -> Column:
        total = s["ca"] * s["cb"]
        return F.struct((s["home"] / total).alias("home"), (s["draw"] / total).alias("draw"), (s["away"] / total).alias("away"))

    return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), start, add, scaled)


def both_score(home: Column, away: Column) -> Column:
    return (1 - F.exp(-home)) * (1 - F.exp(-away))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def two_way_reference(a: Column, b: Column) -> Column:
    """Side a's chance from two last prices; prices of 1 or less say nothing."""
    return F.when((a > 1) & (b > 1), (1 / a) / (1 / a + 1 / b))


def _root(low: float, high: float, falling, steps: int = 60) -> Column:
    """The root of a falling function by bisection, inside one expression."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = falling(mid) > 0
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda s: (s["lo"] + s["hi"]) / 2)


def devig(odds: Column, method: str) -> Column:
    """Margin-free chances of an array of odds. proportional, additive, power, odds_ratio or shin."""
    total = F.aggregate(odds, F.lit(0.0), lambda s, o: s + 1 / o)
    if method == "proportional":
        return F.transform(odds, lambda o: 1 / o / total)
    if method == "additive":
        raw = F.transform(odds, lambda o: F.greatest(F.lit(0.0), 1 / o - (total - 1) / F.size(odds)))
    elif method == "power":
        k = _root(0.01, 50.0, lambda k: F.aggregate(odds, F.lit(0.0), lambda s, o: s + F.pow(1 / o, k)) - 1)
        raw = F.transform(odds, lambda o: F.pow(1 / o, k))
    elif method == "odds_ratio":
        c = _root(1e-6, 1e4, lambda c: F.aggregate(odds, F.lit(0.0), lambda s, o: s + 1 / (c * (o - 1) + 1)) - 1)
        raw = F.transform(odds, lambda o: 1 / (c * (o - 1) + 1))
    elif method == "shin":
        chance = lambda o, z: (F.sqrt(z * z + 4 * (1 - z) / (o * o) / total) - z) / (2 * (1 - z))
        z = _root(0.0, 0.999, lambda z: F.aggregate(odds, F.lit(0.0), lambda s, o: s + chance(o, z)) - 1)
        raw = F.transform(odds, lambda o: chance(o, z))
    else:
        raise ValueError(f"unknown method: {method}")
    return F.transform(raw, lambda p: p / F.aggregate(raw, F.lit(0.0), lambda s, x: s + x))
