"""Where datasets live: heat, cost and the plan of moves, carried out with Spark's storage levels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

DEVICE, HOST, COLD = "DEVICE", "HOST", "COLD"
# Bytes per microsecond that each tier scans, launch cost, and the policy's weights.
SCAN_RATE = {DEVICE: 240_000, HOST: 10_000, COLD: 3_000}
LAUNCH_MICROS = {DEVICE: 30, HOST: 0, COLD: 0}
ALPHA, HYSTERESIS, HORIZON, MIN_RESIDENCY, SWAP_MARGIN = 0.5, 1.5, 8, 2, 1.5
LEVELS = {DEVICE: StorageLevel.MEMORY_ONLY, HOST: StorageLevel.MEMORY_AND_DISK, COLD: StorageLevel.DISK_ONLY}


def scan_micros(size: int, tier: str) -> float:
    return LAUNCH_MICROS[tier] + size / SCAN_RATE[tier]


def move_micros(size: int, source: str, target: str) -> float:
    return 0.0 if source == target else size / min(SCAN_RATE[source], SCAN_RATE[target])


def cheaper_tier(size: int) -> str:
    """The tier that scans this size in less time."""
    return DEVICE if scan_micros(size, DEVICE) < scan_micros(size, HOST) else HOST


@dataclass
class Resident:
    size: int
    tier: str = HOST
    heat: float = 0.0
    recent: float = 0.0
    ticks: int = MIN_RESIDENCY

    @property
    def scans_ahead(self) -> int:
        return max(0, min(HORIZON, round(self.heat / self.size))) if self.size else 0


@dataclass
class Tiering:
    """Heat by scanned bytes; each rebalance() plans promotions, evictions and swaps between HOST and COLD."""

    budget: int
    every: int = 4
    items: dict[str, Resident] = field(default_factory=dict)
    scans: int = 0
    rebalances: int = 0
    migrations: int = 0
    borrows: int = 0

    def add(self, name: str, size: int, tier: str = HOST) -> None:
        self.items[name] = Resident(size, tier)

    def scanned(self, name: str) -> list[tuple[str, str]]:
        """Record a scan; every few scans the plan is made and returned."""
        item = self.items[name]
        item.recent += item.size
        self.borrows += item.tier == COLD
        self.scans += 1
        return self.rebalance() if self.scans % max(1, self.every) == 0 else []

    def used(self) -> int:
        return sum(i.size for i in self.items.values() if i.tier == HOST)

    def gain(self, item: Resident) -> float:
        """Microseconds saved over the scans ahead by HOST instead of COLD."""
        return item.scans_ahead * (scan_micros(item.size, COLD) - scan_micros(item.size, HOST))

    def rebalance(self) -> list[tuple[str, str]]:
        for item in self.items.values():
            item.heat, item.recent = ALPHA * item.recent + (1 - ALPHA) * item.heat, 0.0
            item.ticks += 1
        self.rebalances += 1
        moves: list[tuple[str, str]] = []

        def move(name: str, tier: str) -> None:
            self.items[name].tier, self.items[name].ticks = tier, 0
            moves.append((name, tier))

        def coldest(settled: bool = True) -> list[str]:
            held = [n for n, i in self.items.items() if i.tier == HOST and (i.ticks >= MIN_RESIDENCY or not settled)]
            return sorted(held, key=lambda n: self.gain(self.items[n]))

        for name in coldest():
            if self.used() <= self.budget:
                break
            move(name, COLD)
        wanted = [n for n, i in self.items.items() if i.tier == COLD and i.ticks >= MIN_RESIDENCY and self.gain(i) > HYSTERESIS * move_micros(i.size, COLD, HOST)]
        for name in sorted(wanted, key=lambda n: -self.gain(self.items[n])):
            item = self.items[name]
            if self.used() + item.size <= self.budget:
                move(name, HOST)
                continue
            out = next((n for n in coldest() if self.gain(item) > SWAP_MARGIN * self.gain(self.items[n]) and self.used() - self.items[n].size + item.size <= self.budget), None)
            if out:
                move(out, COLD)
                move(name, HOST)
        self.migrations += len(moves)
        return moves


def carry_out(moves: list[tuple[str, str]], frames: dict[str, DataFrame]) -> None:
    """Move cached datasets between storage levels; names that are gone are skipped."""
    for name, tier in moves:
        if name in frames:
            frames[name].unpersist()
            frames[name].persist(LEVELS[tier])
