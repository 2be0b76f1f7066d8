"""Redistricting scenarios: what may move, what must stay whole, what it costs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# fixed values: administrative levels from fine to coarse
LEVELS = ["MANZENT", "ID_DIST", "CUT", "COD_PROVINCIA", "COD_REGION"]
DECISION_UNITS = {"CUT", "ID_DIST", "MANZENT"}
REFORMS = {"vigente", "contrafactual_fuerte", "contrafactual_intermedio", "control_metodologico", "contrafactual_regional"}
MODES = {"hard", "soft", "none"}
ISLANDS = {"nearest", "threshold", "none"}


@dataclass(frozen=True)
class Scenario:
    """``preserve`` maps a level to its mode and ``penalty`` to its weight.

    Both also take one value for all of ``units``; a single weight only
    counts for soft levels.
    """

    name: str
    reform: str = "vigente"
    decision_unit: str = "CUT"
    units: tuple[str, ...] = ()
    preserve: str | dict[str, str] = "hard"
    penalty: float | dict[str, float] = 0.0
    pop_col: str = "viviendas"
    pop_tolerance: float = 0.05
    n_districts: int = 8
    magnitudes: dict[int, int] | None = None
    island_policy: str = "nearest"
    island_km: float = 50.0
    notes: dict[str, str] = field(default_factory=dict)

    def modes(self) -> dict[str, str]:
        return dict(self.preserve) if isinstance(self.preserve, dict) else dict.fromkeys(self.units, self.preserve)

    def penalties(self) -> dict[str, float]:
        if isinstance(self.penalty, dict):
            return dict(self.penalty)
        return {u: self.penalty for u in self.units if self.modes().get(u) == "soft"}


def problems(s: Scenario) -> list[tuple[str, str]]:
    """(severity, message) of everything wrong or doubtful in a scenario."""
    found: list[tuple[str, str]] = []

    def error(bad: bool, message: str) -> None:
        if bad:
            found.append(("error", message))

    modes, penalties = s.modes(), s.penalties()
    error(s.decision_unit not in DECISION_UNITS, f"unknown decision unit {s.decision_unit!r}")
    error(s.reform not in REFORMS, f"unknown reform {s.reform!r}")
    if isinstance(s.preserve, dict):
        error(set(modes) != set(s.units), "preserve must name exactly the preserved units")
    else:
        error(s.preserve == "hard" and not s.units, "hard preservation needs at least one unit")
    error(bool((set(modes.values()) or ({s.preserve} if isinstance(s.preserve, str) else set())) - MODES), "unknown preserve mode")
    error(s.island_policy not in ISLANDS, f"unknown island policy {s.island_policy!r}")
    error(s.island_policy == "threshold" and s.island_km <= 0, "island distance must be positive")
    error(s.n_districts < 2, "at least two districts")
    error(s.magnitudes is not None and not isinstance(s.magnitudes, dict), "magnitudes must map district to seats")
    error(not 0 < s.pop_tolerance < 1, "population tolerance must lie between 0 and 1")
    for level, mode in modes.items():
        known = level in LEVELS and s.decision_unit in LEVELS
        if mode == "hard" and known and LEVELS.index(s.decision_unit) < LEVELS.index(level):
            found.append(("warning", f"decision unit finer than hard level {level}"))
        if mode == "soft" and not penalties.get(level, 0.0):
            found.append(("warning", f"soft level {level} without penalty has no effect"))
    if s.pop_col == "viviendas" and s.preserve != "none":
        found.append(("warning", "dwellings stand in for population"))
    return found


def validate(s: Scenario) -> list[str]:
    """Warnings of a sound scenario; raises on errors."""
    found = problems(s)
    errors = [m for severity, m in found if severity == "error"]
    if errors:
        raise ValueError("; ".join(errors))
    return [m for _, m in found]


# fixed values: the predefined scenarios
SCENARIOS = {
    "legal": Scenario("legal_comunas", "vigente", "CUT", ("CUT",), "hard", pop_col="personas", pop_tolerance=0.1),
    "apc_strict": Scenario("apc_comunas_preservadas", "control_metodologico", "ID_DIST", ("CUT",), "hard"),
    "apc_soft": Scenario("contrafactual_apc_soft", "contrafactual_intermedio", "ID_DIST", ("CUT",), "soft", 0.25,
                         pop_col="personas", pop_tolerance=0.1),
    "apc_free": Scenario("contrafactual_apc_libre", "contrafactual_fuerte", "ID_DIST", (), "none",
                         pop_col="personas", pop_tolerance=0.1),
    "comunas_hard_region_soft": Scenario(
        "comunas_hard_region_soft", "contrafactual_regional", "CUT", ("CUT", "COD_REGION"),
        {"CUT": "hard", "COD_REGION": "soft"}, {"CUT": 0.0, "COD_REGION": 0.25}),
    "comunas_hard_region_hard": Scenario(
        "comunas_hard_region_hard", "contrafactual_regional", "CUT", ("CUT", "COD_REGION"), {"CUT": "hard", "COD_REGION": "hard"}),
    "region_soft_only": Scenario(
        "region_soft_only", "contrafactual_regional", "CUT", ("COD_REGION",), {"COD_REGION": "soft"}, {"COD_REGION": 0.25}),
}


def rules_table(spark: SparkSession, scenarios: dict[str, Scenario] = SCENARIOS) -> DataFrame:
    """(scenario, reform, decision_unit, modes, penalties, tolerance) rows."""
    rows = [(s.name, s.reform, s.decision_unit, s.modes(), s.penalties(), s.pop_tolerance) for s in scenarios.values()]
    return spark.createDataFrame(
        rows, "scenario string, reform string, decision_unit string, modes map<string,string>, "
        "penalties map<string,double>, pop_tolerance double")
