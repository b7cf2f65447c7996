"""Named queries by theme. ``load`` imports every theme, which fills the registry."""

from importlib import import_module

THEMES = ["cleaning", "featuring", "evaluation", "matching", "modeling"]


def load() -> None:
    for theme in THEMES:
        import_module(f"tunegauge.plans.{theme}")
