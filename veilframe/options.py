"""Per-label synthesis options.  Defaults are part of the contract (fixed values)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

from . import model


def as_text(value: object) -> str | None:
    """Swap targets and constants given as numbers or booleans become their text."""
    return None if value is None else str(value)


@dataclass(frozen=True)
class Options:
    """``swaps`` (exact value -> replacement) win over ``constant``, which wins over the
    generator."""

    swaps: Mapping[str, str] = field(default_factory=dict)
    constant: str | None = None
    version: str = "V1"
    generator: str | None = None

    def __post_init__(self) -> None:
        if self.version not in ("V1", "V2"):
            raise ValueError(f"unknown generator version {self.version}")
        if self.generator is not None and self.generator not in model.GENERATORS:
            raise ValueError(f"unknown generator {self.generator}")
        swaps = {str(k): as_text(v) for k, v in (self.swaps or {}).items()}
        object.__setattr__(self, "swaps", swaps)
        object.__setattr__(self, "constant", as_text(self.constant))


@dataclass(frozen=True)
class NameOptions(Options):
    generator: str = "Name"
    case_sensitive: bool = False
    preserve_gender: bool = False


@dataclass(frozen=True)
class EmailOptions(Options):
    generator: str = "Email"
    preserve_domain: bool = False


@dataclass(frozen=True)
class PhoneOptions(Options):
    generator: str = "PhoneNumber"
    us_format: bool = False
    replace_invalid: bool = True
    preserve_area_code: bool = False


@dataclass(frozen=True)
class DateOptions(Options):
    generator: str = "DateTime"
    scramble_unrecognized: bool = True
    extra_formats: tuple[str, ...] = ()
    constant_shift: bool = False
    group_year: bool = False
    left_days: int = -7
    right_days: int = 7
    as_of_year: int = 2024

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "extra_formats", tuple(self.extra_formats))
        if self.left_days > self.right_days:
            raise ValueError("left_days must not exceed right_days")


@dataclass(frozen=True)
class AgeOptions(Options):
    generator: str = "PersonAge"
    scramble_unrecognized: bool = True
    shift_years: int = 7
    pass_through_to_89: bool = False


@dataclass(frozen=True)
class AddressOptions(Options):
    generator: str = "HipaaAddressGenerator"
    non_hipaa: bool = False
    replace_truncated_zeros: bool = True
    realistic: bool = True
    three_digit_zips: bool = False
    foreign_zeros: bool = False


@dataclass(frozen=True)
class NumericOptions(Options):
    generator: str = "NumericValue"
    integer_key: bool = False


BY_GENERATOR: dict[str, type[Options]] = {
    "Name": NameOptions,
    "Email": EmailOptions,
    "PhoneNumber": PhoneOptions,
    "DateTime": DateOptions,
    "PersonAge": AgeOptions,
    "HipaaAddressGenerator": AddressOptions,
    "NumericValue": NumericOptions,
}


def family_of(label: str) -> type[Options]:
    return BY_GENERATOR.get(model.GENERATOR_OF.get(label, ""), Options)


def default_options(label: str) -> Options:
    generator = model.GENERATOR_OF.get(label, "Scramble")
    family = BY_GENERATOR.get(generator)
    return family() if family else Options(generator=generator)


def generator_of(label: str, options: Options | None) -> str:
    if options is not None and options.generator:
        return options.generator
    return model.GENERATOR_OF.get(label, "Scramble")


def to_json(options: Options) -> str:
    return json.dumps(asdict(options), sort_keys=True)


def from_json(text: str, label: str | None = None) -> Options:
    """Back from JSON; the generator kind decides the class."""
    data = json.loads(text)
    generator = data.get("generator")
    family = BY_GENERATOR.get(generator) if generator else family_of(label or "")
    family = family or Options
    known = {f.name for f in fields(family)}
    unknown = set(data) - known
    if unknown:
        raise ValueError(f"options not valid for {generator}: {sorted(unknown)}")
    return family(**data)
