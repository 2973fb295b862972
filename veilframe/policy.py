"""What to do with each label: state, options, lists, seed.

A policy is a handful of rows known on the driver; operators compile it into the plan,
so labels that are off cost nothing and no join is needed to look a state up.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from .functions.sql import Sql, fn, lit, when
from .functions.tokens import LABEL_REGEX

from . import model
from .options import Options, family_of, generator_of

_STATES_HELP = "known states: " + ", ".join(model.STATES)
_KEYS_HELP = "a label must be built in or named in custom_entities"


@dataclass(frozen=True)
class Policy:
    default: str = model.REDACTION
    config: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, Options] = field(default_factory=dict)
    allow: Mapping[str, Sequence[str]] = field(default_factory=dict)
    block: Mapping[str, Sequence[str]] = field(default_factory=dict)
    custom: Mapping[str, Sequence[str]] = field(default_factory=dict)
    custom_entities: Sequence[str] = ()
    path_allow: Mapping[str, Sequence[str]] = field(default_factory=dict)
    path_ignore: Sequence[str] = ()
    seed: int | str | None = None
    token_width: int = 16
    #: Whether labels that are off still claim the text they match, so that e.g. a phone
    #: number that is off is not redacted as a bare number.  Without it their detectors
    #: are left out of the plan altogether.
    claim_off: bool = True

    def validate(self) -> "Policy":
        known = set(model.LABELS) | set(self.custom_entities)
        if self.default not in model.STATES:
            raise ValueError(f"the default state {self.default!r} is unknown; {_STATES_HELP}")
        if set(self.config) - known:
            raise ValueError(f"a state is given for labels nobody knows: {sorted(set(self.config) - known)}; {_KEYS_HELP}")
        if set(self.config.values()) - set(model.STATES):
            raise ValueError(f"a label has an unknown state; {_STATES_HELP}")
        if set(self.options) - known:
            raise ValueError(f"options are given for labels nobody knows: {sorted(set(self.options) - known)}; {_KEYS_HELP}")
        for label, options in self.options.items():
            expected = family_of(label) if label in model.LABELS else Options
            if not isinstance(options, expected):
                raise ValueError(
                    f"options of {label} are {type(options).__name__}, "
                    f"which takes {expected.__name__}"
                )
            kind = generator_of(label, options)
            natural = model.GENERATOR_OF.get(label)
            if natural and expected is not Options and kind != natural:
                raise ValueError(
                    f"options of {label} name the generator {kind}; "
                    f"{expected.__name__} go with {natural}"
                )
        odd = [x for x in {*self.custom, *self.custom_entities} if not re.fullmatch(LABEL_REGEX, x)]
        if odd:
            raise ValueError(f"names of custom entities must look like {LABEL_REGEX}: {odd}")
        if not 8 <= self.token_width <= 64:
            raise ValueError("token_width must be between 8 and 64")
        return self

    # -- states ---------------------------------------------------------------------

    def state_of(self, label: str) -> str:
        return self.config.get(label, self.default)

    def is_on(self, label: str) -> bool:
        return self.state_of(label) != model.OFF

    def labels_on(self) -> list[str]:
        return [label for label in model.LABELS if self.is_on(label)]

    def enabled_labels(self) -> list[str]:
        """Explicitly configured labels that are not off."""
        return [label for label, state in self.config.items() if state != model.OFF]

    def state(self, label: Sql) -> Sql:
        """Effective state per row: explicit config wins, else the default."""
        by_state: dict[str, list[str]] = {}
        for name, state in self.config.items():
            if state != self.default:
                by_state.setdefault(state, []).append(name)
        result = lit(self.default)
        for state, names in by_state.items():
            result = when(label.isin(names), lit(state)).otherwise(result)
        return result

    def keep(self, spans: Sql) -> Sql:
        """Drop spans whose effective state is Off."""
        off = [name for name, state in self.config.items() if state == model.OFF]
        on = [name for name, state in self.config.items() if state != model.OFF]
        if self.default == model.OFF:
            return fn.filter(spans, lambda s: s["label"].isin(on))
        return fn.filter(spans, lambda s: ~s["label"].isin(off)) if off else spans

    def with_changes(self, **given: object) -> "Policy":
        """Partial edit: only the fields that are given change."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})
