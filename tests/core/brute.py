"""What trades should be, bar by bar."""

from __future__ import annotations


class TrailingPosition:
    """An open position whose barriers only ever move in its favour."""

    def __init__(self, side: int, ts: int, p: float, price: float, deadline: int):
        self.side, self.ts, self.p, self.price, self.deadline = side, ts, p, price, deadline
        self.target = self.stop = float("-inf")  # in units of side * price
        self.updates = -1

    def signal(self, price: float, sigma: float, up: float, down: float) -> None:
        """Barriers from this price, kept where they are better."""
        self.target = max(self.target, self.side * price * (1 + self.side * up * sigma))
        self.stop = max(self.stop, self.side * price * (1 - self.side * down * sigma))
        self.updates += 1

    def leaves(self, ts: int, high: float, low: float, close: float) -> tuple[float, str] | None:
        """Price and reason of leaving on a bar: stop first, then target, then time."""
        worst, best = (low, high) if self.side > 0 else (-high, -low)
        if worst <= self.stop:
            return self.side * self.stop, "sl"
        if best >= self.target:
            return self.side * self.target, "tp"
        return (close, "vertical") if ts >= self.deadline else None


def trailing_path(rows, bar_ms: int, fee: float, up: float, down: float, max_holding: int, band: float = 0.0) -> list[tuple]:
    """Trades of one series of (timestamp, p_up, side, high, low, close, sigma) rows in time order."""
    out, held = [], None
    for ts, p, side, high, low, close, sigma in rows:
        signal = p > 0.5 + band and side in (1, -1) and sigma is not None and 0 < sigma < float("inf")
        if held:
            left = held.leaves(ts, high, low, close)
            if not left:
                if signal and side == held.side:
                    held.signal(close, sigma, up, down)
                continue
            price, reason = left
            gross = held.side * (price / held.price - 1)
            out.append((held.ts, ts, held.side, max(1, (ts - held.ts) // bar_ms), held.p, held.price, price, reason, held.updates, gross, gross - 2 * fee))
            held = None
        if signal:
            held = TrailingPosition(int(side), ts, p, close, ts + max_holding * bar_ms)
            held.signal(close, sigma, up, down)
    return out


def single_position(rows):
    """Of (entry, exit, ...) rows those that a single position takes."""
    out, busy = [], None
    for row in sorted(rows):
        if busy is None or row[0] >= busy:
            out.append(row)
            busy = row[1]
    return out
