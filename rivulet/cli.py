"""python -m rivulet.cli: signal, run, status and check for a folder of models and a warehouse; check-config for settings."""

from __future__ import annotations

import argparse
import sys

from rivulet.sources.models import Dag, load_models


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rivulet")
    p.add_argument("verb", choices=["signal", "run", "status", "check", "check-config"])
    p.add_argument("names", nargs="*", help="for signal: a source and its partitions; for check-config: a file")
    p.add_argument("--models", default="definitions")
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--columns", help="comma-separated columns that changed in place")
    p.add_argument("--ratio", type=float, default=0.25)
    p.add_argument("--budget", type=float)
    a = p.parse_args(argv)
    if a.verb == "check-config":
        from rivulet.sources.tables import load_settings

        try:
            print(load_settings(a.names[0]))
        except (ValueError, TypeError, OSError, IndexError) as e:
            print(f"bad settings: {e}", file=sys.stderr)
            return 2
        return 0
    from rivulet.operators.engine import Engine, Policy
    from rivulet.session import session

    engine = Engine(session(), Dag(load_models(a.models)), a.warehouse, Policy(full_refresh_ratio=a.ratio, budget_seconds=a.budget))
    if a.verb == "signal":
        engine.signal(a.names[0], a.names[1:] or "ALL", columns=a.columns.split(",") if a.columns else None)
    elif a.verb == "run":
        report = engine.run_once()
        print("\n".join([*report.steps, *(f"{m}: deferred, {why}" for m, why in report.deferred.items())]))
    elif a.verb == "status":
        print("\n".join(f"{m}: {', '.join(x)}" for m, x in engine.status().items()) or "clean")
    else:
        print(engine.check())
    return 0


if __name__ == "__main__":
    sys.exit(main())
