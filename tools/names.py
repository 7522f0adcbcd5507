"""Print the query names of one catalog module."""
import importlib, sys
from pathlib import Path
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from scoreloom.catalog import base
importlib.import_module(f"scoreloom.catalog.{sys.argv[1]}")
print(" ".join(base.CATALOG))
