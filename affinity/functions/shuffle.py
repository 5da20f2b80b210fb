"""The seeded shuffle of compat sampling: a splittable generator and Fisher-Yates."""

from __future__ import annotations

MASK = (1 << 64) - 1
# fixed values: constants of the 64-bit finaliser and of the 32-bit variant
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SHORT_A, SHORT_B = 0x62A9D9ED799705F5, 0xCB24D0A5C88C35B3


def mix64(value: int) -> int:
    value &= MASK
    value = (value ^ value >> 30) * MIX_A & MASK
    value = (value ^ value >> 27) * MIX_B & MASK
    return value ^ value >> 31


class Splittable:
    """Numbers below a bound, as the JVM's splittable generator draws them."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def next32(self) -> int:
        self.state = (self.state + GAMMA) & MASK
        z = (self.state ^ self.state >> 33) * SHORT_A & MASK
        return ((z ^ z >> 28) * SHORT_B & MASK) >> 32

    def below(self, bound: int) -> int:
        r = self.next32()
        if bound & (bound - 1) == 0:
            return r & (bound - 1)
        while True:
            u = r >> 1
            r = u % bound
            if u + bound - 1 - r < 1 << 31:
                return r
            r = self.next32()


def item_seed(item: int, code: int, seed: int) -> int:
    return mix64(item) ^ mix64(code) ^ (seed & MASK)


def shuffled(users: list[int], seed: int) -> list[int]:
    """Fisher-Yates from the last place down, over the ascending users."""
    out, draw = sorted(users), Splittable(seed)
    for i in range(len(out) - 1, 0, -1):
        j = draw.below(i + 1)
        out[i], out[j] = out[j], out[i]
    return out
