"""State transitions shared by the batch twins and the streaming processors."""

from __future__ import annotations

from dataclasses import dataclass, field

# Breaker window, failure limit, pause, probes; bucket size and refill per minute; cache lifetime.
WINDOW, FAILURE_LIMIT, PAUSE_SECONDS, PROBES, PROBE_SUCCESS = 20, 0.3, 60.0, 3, 0.5
BUCKET, REFILL_PER_MINUTE = 20, 20
TTL_SECONDS = 3600.0


@dataclass
class Breaker:
    """closed, open or half_open, with the last results of the key (True = failed)."""

    window: int = WINDOW
    limit: float = FAILURE_LIMIT
    pause: float = PAUSE_SECONDS
    status: str = "closed"
    results: list[bool] = field(default_factory=list)
    opened_at: float = 0.0
    probes: int = 0
    successes: int = 0

    def admit(self, now: float) -> bool:
        if self.status == "open" and now - self.opened_at >= self.pause:
            self.status, self.probes, self.successes = "half_open", 0, 0
        if self.status == "half_open":
            if self.probes >= PROBES:
                return False
            self.probes += 1
            return True
        return self.status == "closed"

    def record(self, now: float, failed: bool) -> None:
        self.results = [*self.results, failed][-self.window:]
        if self.status == "half_open":
            self.successes += not failed
            if self.probes >= PROBES:
                if self.successes / self.probes >= PROBE_SUCCESS:
                    self.status, self.results, self.probes, self.successes = "closed", [], 0, 0
                else:
                    self._open(now)
        elif self.status == "closed" and len(self.results) >= self.window // 2 and self.rate >= self.limit:
            self._open(now)

    def _open(self, now: float) -> None:
        self.status, self.opened_at, self.probes, self.successes = "open", now, 0, 0

    def encode(self) -> str:
        bits = "".join("1" if r else "0" for r in self.results)
        return f"{self.status}|{bits}|{self.opened_at!r}|{self.probes}|{self.successes}"

    def decode(self, text: str) -> Breaker:
        """Takes over an encoded state."""
        self.status, bits, opened_at, probes, successes = text.split("|")
        self.results, self.opened_at, self.probes, self.successes = [b == "1" for b in bits], float(opened_at), int(probes), int(successes)
        return self

    @property
    def rate(self) -> float:
        return sum(self.results) / len(self.results) if self.results else 0.0

    def step(self, now: float, failed: bool, gated: bool = True) -> dict:
        """One request; ungated, its result counts whether or not it would have been let through."""
        allowed = self.admit(now)
        if allowed or not gated:
            self.record(now, failed)
        return {"allowed": allowed, "status": self.status, "failure_rate": self.rate}


def bucket_step(
    tokens: float | None, last: float | None, now: float, cap: int = BUCKET, per_minute: int = REFILL_PER_MINUTE
) -> tuple[float, bool]:
    """Refill for the time since the last request, spend one token if there is one; a request that comes late refills nothing."""
    tokens = float(cap) if tokens is None else min(tokens + max(now - last, 0.0) * per_minute / 60.0, float(cap))
    return (tokens - 1.0, True) if tokens >= 1.0 else (tokens, False)


def ttl_step(stored_at: float | None, now: float, ttl: float = TTL_SECONDS) -> tuple[float, bool]:
    """A hit leaves the entry as it is; a miss stores it anew."""
    hit = stored_at is not None and now - stored_at <= ttl
    return (stored_at if hit else now), hit
