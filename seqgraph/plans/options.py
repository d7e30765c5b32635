"""Options of the whole assembly with their presets and checks."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, replace

K_MAX = 255
#: The default and preset lists of k.
DEFAULT_K = (21, 29, 39, 59, 79, 99, 119, 141)
PRESETS = {
    "meta-sensitive": {"min_count": 1, "k_list": (21, 29, 39, 49, 59, 69, 79, 89, 99, 109, 119, 129, 141)},
    "meta-large": {"min_count": 1, "k_list": (27, 37, 47, 57, 67, 77, 87, 97, 107, 117, 127)},
}


@dataclass(frozen=True)
class Options:
    k_list: tuple[int, ...] = DEFAULT_K
    min_count: int = 2
    mercy: bool = True
    one_pass: bool = False
    bubble_level: int = 2
    merge_len: float = 20
    merge_similar: float = 0.95
    prune_level: int = 2
    prune_depth: float = 2
    disconnect_ratio: float = 0.1
    low_local_ratio: float = 0.2
    cleaning_rounds: int = 5
    local: bool = True
    min_contig_len: int = 200
    max_tip_len: int = -1
    auto_k: bool = True
    memory: float = 0.9
    threads: int = 0
    mem_flag: int = 1
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.k_list:
            raise ValueError("k list is empty")
        for k in self.k_list:
            if k % 2 == 0:
                raise ValueError(f"k must be odd: {k}")
            if not 15 <= k <= K_MAX:
                raise ValueError(f"k must be in 15..{K_MAX}: {k}")
        for a, b in zip(self.k_list, self.k_list[1:]):
            if b <= a:
                raise ValueError("k list must rise")
            if b - a > 28:
                raise ValueError(f"step from {a} to {b} is more than 28")
        if self.min_count < 1:
            raise ValueError("min_count must be positive")
        if not 0 <= self.prune_level <= 3 or self.merge_len < 0 or self.cleaning_rounds < 1:
            raise ValueError("prune_level is 0 to 3, merge_len at least 0, cleaning_rounds at least 1")
        if self.prune_depth < 0 and self.prune_level < 3:  # at level 3 it's inferred from the multiplicities
            object.__setattr__(self, "prune_depth", self.min_count)
        object.__setattr__(self, "bubble_level", max(0, min(2, self.bubble_level)))
        if not 0 <= self.merge_similar <= 1 or not 0 <= self.disconnect_ratio <= 0.5 or not 0 < self.low_local_ratio <= 0.5:
            raise ValueError("a ratio is out of range")
        if self.min_count == 1:  # nothing is below the threshold
            object.__setattr__(self, "one_pass", True)
            object.__setattr__(self, "mercy", False)
        if self.memory != 0.9 or self.threads or self.mem_flag != 1:
            warnings.warn("memory, threads and mem_flag have no meaning here; set Spark's configuration instead", stacklevel=2)

    @classmethod
    def by_step(cls, k_min: int, k_max: int, k_step: int, **more) -> Options:
        """k from k_min by even steps, with k_max as the last."""
        if k_step % 2 or k_step <= 0:
            raise ValueError("k_step must be even")
        if k_min > k_max:
            raise ValueError("k_min is more than k_max")
        return cls(k_list=(*range(k_min, k_max, k_step), k_max), auto_k=False, **more)

    @classmethod
    def preset(cls, name: str, **more) -> Options:
        return cls(**(PRESETS[name] | more))

    def for_reads(self, longest: int) -> Options:
        """Without the k that no read is long enough for; an explicit list is kept whole with auto_k off."""
        if not self.auto_k:
            return self
        ks = tuple(k for k in self.k_list if k < longest + 20)
        return replace(self, k_list=ks or self.k_list[:1])

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Options:
        d = json.loads(text)
        return cls(**(d | {"k_list": tuple(d["k_list"])}))

    def min_standalone(self) -> int:
        """Length from which isolated contigs of a lower k are final."""
        if self.max_tip_len >= 0:
            return max(self.max_tip_len + self.k_list[-1] - 1, self.min_contig_len)
        return max(min(self.k_list[-1] * 3 - 1, int(self.min_contig_len * 1.5)), self.min_contig_len)

    def tip_len(self, k: int) -> int:
        """Greatest tip for a k; -1 leaves it at 2k."""
        if self.max_tip_len == -1 and k * 3 - 1 > self.min_contig_len * 1.5:
            return max(1, int(self.min_contig_len * 1.5 + 1 - k))
        return self.max_tip_len
