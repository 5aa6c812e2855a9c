"""The pass pipeline over a loaded ledger: plugins in order, pads, checks."""

from __future__ import annotations

from ledgerlake.model import DIAGNOSTIC, Ledger
from ledgerlake.operators import validate
from ledgerlake.operators.plugins import PLUGINS, resequence


def _name(full: str) -> str:
    return full.rsplit(".", 1)[-1].replace("-", "_")


def settled(ledger: Ledger) -> Ledger:
    """The ledger with its tables kept, so that the passes after this one don't repeat those before."""
    return Ledger(ledger.spark, ledger.entries.persist(), ledger.postings.persist(), ledger.options, ledger.diagnostics)


def run(ledger: Ledger, plugins: list[tuple[str, str | None]] = (), checks: bool = True) -> Ledger:
    """Each plugin sees what the one before made; an unknown name is a diagnostic."""
    ledger = settled(ledger)
    found = [ledger.diagnostics] if ledger.diagnostics is not None else []
    for full, config in plugins:
        f = PLUGINS.get(_name(full))
        if f is None:
            found.append(ledger.spark.createDataFrame([("unknown-plugin", "error", None, None, None, f"no plugin {full}")], DIAGNOSTIC))
            continue
        ledger, diag = f(ledger, config)
        ledger = settled(resequence(ledger))
        if diag is not None:
            found.append(diag)
    if checks:
        ledger, diag = validate.pad(ledger)
        ledger = settled(ledger)
        found += [diag, validate.validate(ledger)]
    out = None
    for d in found:
        out = d if out is None else out.unionByName(d)
    return Ledger(ledger.spark, ledger.entries, ledger.postings, ledger.options, out)
