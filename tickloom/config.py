"""Protocol parameters: roles, date ranges, window geometry, seeds and tolerances."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DateRule:
    """An inclusive date range that applies to one role."""

    name: str
    role: str
    start: str
    end: str
    stride: int = 1


@dataclass(frozen=True)
class Protocol:
    target: str = "T0"
    channels: tuple[str, ...] = ("log_return", "log_high_low_range", "log1p_volume")
    context: int = 60
    horizon: int = 5
    test_stride: int = 5
    abs_tolerance: float = 1e-10
    rel_tolerance: float = 1e-12
    min_coverage: float = 0.96
    seeds: tuple[int, ...] = (42, 123, 2026)
    shares: tuple[float, ...] = (0.25, 0.50, 0.75)
    space: str = "global_channel_normalized"
    # Feature blocks may overlap on purpose: a target row can sit in several.
    blocks: tuple[DateRule, ...] = field(
        default=(
            DateRule("donor_train", "donor", "1995-01-01", "1999-12-31", 5),
            DateRule("donor_validation", "donor", "2000-01-01", "2000-12-31", 5),
            DateRule("visible", "target", "2000-07-01", "2000-12-31", 1),
            DateRule("full_history", "target", "1995-01-01", "2000-12-31", 1),
            DateRule("test_source", "target", "2000-07-01", "2001-11-04", 1),
        )
    )
    # Split labels are exclusive; rows outside every rule become "unused".
    splits: tuple[DateRule, ...] = field(
        default=(
            DateRule("donor_train", "donor", "1995-01-01", "1999-12-31"),
            DateRule("donor_validation", "donor", "2000-01-01", "2000-12-31"),
            DateRule("hidden", "target", "1995-01-01", "2000-06-30"),
            DateRule("visible", "target", "2000-07-01", "2000-12-31"),
            DateRule("test", "target", "2001-01-01", "2001-11-04"),
        )
    )

    @property
    def length(self) -> int:
        return self.context + self.horizon

    @property
    def width(self) -> int:
        return self.length * len(self.channels)

    def block(self, name: str) -> DateRule:
        return next(rule for rule in self.blocks if rule.name == name)

    def split(self, name: str) -> DateRule:
        return next(rule for rule in self.splits if rule.name == name)


PROTOCOL = Protocol()
