"""The configuration file: 'key: value' lines, and a [correct] section that
may list the steps of the correction."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, field
from typing import Any

from phasegrid.operators.rasters import two_factors

#: Fixed values of the format: name -> (type, default, least, most, choices).
#: A default of REQUIRED must be given.
REQUIRED = object()
PARAMETERS: dict[str, tuple] = {
    "ifgfilelist": (str, REQUIRED, None, None, None),
    "demfile": (str, REQUIRED, None, None, None),
    "demHeaderFile": (str, REQUIRED, None, None, None),
    "hdrfilelist": (str, REQUIRED, None, None, None),
    "cohfilelist": (str, None, None, None, None),
    "basefilelist": (str, None, None, None, None),
    "ltfile": (str, None, None, None, None),
    "outdir": (str, REQUIRED, None, None, None),
    "processor": (int, None, None, None, (0, 1, 2)),
    "noDataAveragingThreshold": (float, 0.0, 0, None, None),
    "noDataValue": (float, 0.0, None, None, None),
    "nan_conversion": (int, 0, None, None, (0, 1)),
    "largetifs": (int, 0, None, None, (0, 1)),
    "parallel": (int, 0, None, None, (0, 1)),
    "processes": (int, 8, 1, None, None),
    "cohmask": (int, 0, None, None, (0, 1)),
    "cohthresh": (float, 0.3, 0.0, 1.0, None),
    "ifgcropopt": (int, 4, 1, 4, (1, 2, 3, 4)),
    "ifglksx": (int, 1, 1, None, None),
    "ifglksy": (int, 1, 1, None, None),
    "ifgxfirst": (float, None, None, None, None),
    "ifgxlast": (float, None, None, None, None),
    "ifgyfirst": (float, None, None, None, None),
    "ifgylast": (float, None, None, None, None),
    "refx": (float, -1, None, None, None),
    "refy": (float, -1, None, None, None),
    "refnx": (int, 10, 1, 50, None),
    "refny": (int, 10, 1, 50, None),
    "refchipsize": (int, 21, 1, 101, None),
    "refminfrac": (float, 0.5, 0.0, 1.0, None),
    "refest": (int, 1, None, None, (1, 2)),
    "orbfit": (int, 0, None, None, (0, 1)),
    "orbfitmethod": (int, 2, None, None, (1, 2)),
    "orbfitdegrees": (int, 1, None, None, (1, 2, 3)),
    "orbfitlksx": (int, 10, 1, None, None),
    "orbfitlksy": (int, 10, 1, None, None),
    "orbfitintercept": (int, 1, None, None, (0, 1)),
    "orbfitoffset": (int, 0, None, None, (0, 1)),
    "orbfitscale": (int, 100, 1, None, None),
    "apsest": (int, 0, None, None, (0, 1)),
    "slpfcutoff": (float, 1.0, 0, None, None),
    "slpnanfill": (int, 1, None, None, (0, 1)),
    "slpnanfill_method": (str, "nearest", None, None, ("linear", "nearest", "cubic")),
    "tlpfcutoff": (int, 30, 1, None, None),
    "tlpfpthr": (int, 1, 1, None, None),
    "phase_closure": (int, 0, None, None, (0, 1)),
    "closure_thr": (float, 0.5, 0.01, None, None),
    "ifg_drop_thr": (float, 0.5, 0.01, 1.0, None),
    "min_loops_per_ifg": (int, 2, 1, None, None),
    "max_loop_length": (int, 4, 3, None, None),
    "max_loop_redundancy": (int, 2, 1, None, None),
    "subtract_median": (int, 1, None, None, (0, 1)),
    "demerror": (int, 0, None, None, (0, 1)),
    "de_pthr": (int, 10, 4, None, None),
    "tsmethod": (int, 2, None, None, (1, 2)),
    "smorder": (int, None, None, None, (1, 2)),
    "smfactor": (float, -1.0, -5.0, 0, None),
    "ts_pthr": (int, 3, 1, 1000, None),
    "nsig": (int, 2, 1, 10, None),
    "pthr": (int, 3, 1, None, None),
    "maxsig": (int, 1000, 0, 1000, None),
    "savenpy": (int, 0, 0, 1, (1, 0)),
    "savetsincr": (int, 1, 0, 1, (1, 0)),
    "los_projection": (int, 0, 0, 2, (2, 1, 0)),
    "signal_polarity": (int, -1, -1, 1, (1, -1)),
    "velerror_nsig": (int, 2, 1, None, None),
}
STEPS = ("orbfit", "refphase", "demerror", "phase_closure", "mst", "apscorrect", "maxvar")


class ConfigError(ValueError):
    """A configuration that can't be used."""


def coerce(name: str, text: str | None) -> Any:
    """A parameter's value from text (None or blank: its default), checked."""
    kind, default, least, most, choices = PARAMETERS[name]
    if text is None or not str(text).strip():
        if default is REQUIRED:
            raise ConfigError(f"{name} must be given")
        return default
    try:
        value = kind(str(text).strip())
    except ValueError:
        raise ConfigError(f"{name}: {text!r} is no {kind.__name__}") from None
    if (least is not None and value < least) or (most is not None and value > most):
        raise ConfigError(f"{name}: {value} is outside {least} to {most}")
    if choices and value not in choices:
        raise ConfigError(f"{name}: {value} is none of {choices}")
    return value


@dataclass(frozen=True)
class Config:
    """Typed parameters, and the steps of the correction in order."""

    values: dict[str, Any]
    steps: tuple[str, ...] = STEPS
    tiles: tuple[int, int] = field(default=(1, 1))

    def __getitem__(self, name: str) -> Any:
        return self.values[name]

    @classmethod
    def parse(cls, text: str) -> "Config":
        """From the text of a configuration file."""
        parser = configparser.ConfigParser(delimiters=(":", "="), comment_prefixes=("#",), inline_comment_prefixes=("#",), strict=False, interpolation=None)
        parser.optionxform = str
        parser.read_string("[root]\n" + text)
        given = dict(parser["root"])
        values = {name: coerce(name, given.get(name)) for name in PARAMETERS}
        steps = STEPS
        if parser.has_option("correct", "steps"):
            steps = tuple(s for s in parser["correct"]["steps"].replace(",", " ").split() if s)
            if unknown := [s for s in steps if s not in STEPS]:
                raise ConfigError(f"no such steps: {unknown}")
        config = cls(values, steps, two_factors(values["processes"]))
        config.check()
        return config

    def check(self) -> None:
        """Errors between parameters."""
        if self["cohmask"] and not self["cohfilelist"]:
            raise ConfigError("cohmask needs cohfilelist")
        if self["demerror"] and not self["basefilelist"]:
            raise ConfigError("demerror needs basefilelist")
        if self["ifgcropopt"] == 3 and any(self[k] is None for k in ("ifgxfirst", "ifgxlast", "ifgyfirst", "ifgylast")):
            raise ConfigError("a custom crop needs its four edges")
        if self["refchipsize"] % 2 == 0:
            raise ConfigError("refchipsize must be odd")
        if self["tsmethod"] == 1 and self["smorder"] is None:
            raise ConfigError("tsmethod 1 needs smorder")
        if self["slpnanfill_method"] == "cubic":
            raise ConfigError("slpnanfill_method cubic isn't supported; use nearest or linear")

    def text(self) -> str:
        """A configuration file with all values."""
        lines = [f"{k}: {'' if v is None else v}" for k, v in self.values.items()]
        return "\n".join([*lines, "", "[correct]", "steps =", *[f"    {s}" for s in self.steps], ""])
