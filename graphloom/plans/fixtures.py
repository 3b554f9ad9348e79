"""Small source trees, as (tree, path, text) rows: what the registered code-map queries and their expected rows are about."""

_LOGS = '''\
"""Count requests of a web log by status."""
import argparse
import re
from collections import Counter

LINE = re.compile("(\\\\S+) (\\\\d+) (\\\\d+)")
UNITS = ["B", "kB", "MB"]


def _arguments():
    p = argparse.ArgumentParser()
    p.add_argument("path")
    return p.parse_args()


def _size(text):
    return 0 if text == "-" else int(text)


def _nice(n):
    for unit in UNITS:
        if n < 1000:
            return f"{n} {unit}"
        n /= 1000


def parse(line: str) -> "dict | None":
    found = LINE.match(line)
    if not found:
        return None
    host, status, size = found.groups()
    return {"host": host, "status": int(status), "size": _size(size)}


def tally(lines: "list[str]") -> dict:
    """Sum bytes a status. Bad lines are counted apart."""
    counts, sizes, bad = Counter(), Counter(), 0
    for line in lines:
        row = parse(line)
        if row is None:
            bad += 1
            continue
        if row["status"] >= 400:
            counts["errors"] += 1
        counts[row["status"]] += 1
        sizes[row["status"]] += row["size"]
    return {"counts": counts, "sizes": sizes, "bad": bad}


def report(found: dict) -> str:
    out = ["requests by status", "------------------"]
    for status, n in sorted(found["counts"].items()):
        out.append(f"{status} had {n} hits")
        out.append("of a size of " + _nice(found["sizes"][status]))
    if found["bad"]:
        out.append(f"and {found['bad']} bad lines")
    return "\\n".join(out)


def main():
    a = _arguments()
    with open(a.path) as f:
        print(report(tally(f)))


if __name__ == "__main__":
    main()
'''

_SHOP = {
    "pyproject.toml": '[project]\nname = "shop"\nscripts = { shop = "shop.cli:main" }\n',
    "README.md": "# Shop\n\n[![badge](x)](y)\n\nSells things. And more.\n",
    "shop/__init__.py": 'from .cli import main\n\n__all__ = ["main"]\n',
    "shop/cli.py": '''\
"""
shop.cli
~~~~~~~~

Copyright 2020 The Shop.

Read orders and print what they cost! Then stop.
"""
import os
from os import path
from itertools import chain

import yaml

from . import store
from .models import Order, Status
from .prices import total as total_of, Rates


def main(argv=None):
    orders = load(argv)
    rates = Rates.default()
    for o in chain(orders, []):
        if o.status is Status.OPEN:
            store.save(o, total_of(o, rates))
    return show(orders)


def load(argv):
    where = path.join("a", os.path.basename(str(argv)))
    if not os.stat(where):
        raise SystemExit(2)
    with open(where) as f:
        return [Order(**x) for x in yaml.safe_load(f)]


def show(orders):
    for o in orders:
        print(o.line())
    return len(orders)


@group.command()
def check():
    main()
''',
    "shop/models.py": '''\
# What is sold and bought.

from dataclasses import dataclass
from enum import Enum


class Base(Enum):
    def label(self):
        return self.value


class Status(Base):
    OPEN = 1
    PAID = 2


class Record:
    def line(self):
        return self.text()

    def text(self):
        return ""


@dataclass
class Order(Record):
    name: str
    count: "int" = 1
    status: Status = Status.OPEN

    def text(self):
        return f"{self.name} times {self.count}"

    @property
    def free(self):
        return self._free

    @free.setter
    def free(self, value):
        self._free = check_free(value)


def check_free(value):
    return bool(value)


NAMES = {Status.OPEN: "open", Status.PAID: "paid"}
LIMIT: int = 5
''',
    "shop/prices.py": '''\
from typing import Dict, List, Optional, Tuple, Union, overload

from shop.models import Record


class Rates(Record):
    @classmethod
    def default(cls) -> Optional[Dict[str, float]]:
        return cls.of({"a": 1.0})

    @overload
    def of(table: dict): ...

    @overload
    def of(table: list): ...

    @classmethod
    def of(cls, table: Union[dict, list]) -> "Rates":
        r = cls()
        r.table = dict(table)
        return r

    def price(self, name: str, *more: int, key: Tuple[int, str] = None) -> float:
        while name:
            if name in self.table:
                return self.table[name] if key is None else self.line()
            name = name[1:]
        return 0.0


def total(order, rates: "Rates", extra: List[Tuple[str, ...]] = ()) -> Dict[str, List[int]]:
    def inner(x):
        return helper(x) + 1

    return {"sum": inner(order), **{}, "currency": "EUR"}


def helper(x):
    return unknown.thing(x)
''',
    "shop/store.py": '''\
"""Keep orders."""
import requests
import json


def save(order, cost):
    def body():
        return json.dumps({"order": order, "cost": cost})

    try:
        requests.post("http://localhost/orders", body())
    except requests.exceptions.Timeout:
        retry(order, cost)
    except ValueError:
        pass


def retry(order, cost):
    save(order, cost)
''',
    "shop/broken.py": "def f(:\n",
    "tests/test_cli.py": "from shop.cli import main\n\n\ndef test_main():\n    assert main() == 0\n",
    "build/lib/ignored.py": "def ignored():\n    pass\n",
}

_STEPS = '''\
import os
import shutil
import tarfile


def release(where, names):
    made = []

    # collect the files
    for n in names:
        made.append(os.stat(n))
        shutil.copy(n, where)
        os.chmod(n, 0o644)

    total = 0
    for m in made:
        total += m.st_size

    # TODO: this is too slow
    if total > 10:
        total = 10

    # write the archive
    t = tarfile.open(where)
    t.add(where)
    os.rename(where, where + ".tar")
    os.remove(where)
    shutil.rmtree(where)

    os.sync()
    kept = []
    for m in made:
        kept.append(m.st_mtime)
    answer = total + len(kept)
    if answer:
        answer += 1
    # tell the caller:
    return answer


def short(x):
    # one
    return os.stat(x), os.lstat(x), os.chmod(x, 1)
'''

_SETUP_CFG = "[options.entry_points]\nconsole_scripts =\n    one = pkg.main:run\n    broken line\n    two = pkg.other:go.now\n"
_PACKAGE = "def run():\n    if 1:\n        return go()\n\n\ndef go():\n    return [x for x in range(3)]\n"

#: One tree a way of declaring entry points.
_DECLARED = {
    "declared-cfg": {"setup.cfg": _SETUP_CFG, "pyproject.toml": "[tool.x]\na = 1\n"},
    "declared-literal": {"setup.py": "from setuptools import setup\nsetup(entry_points={'console_scripts': ['one = pkg.main:run', 'bad']})\n"},
    "declared-name": {"setup.py": "S = '[console_scripts]\\none = main'\nif __name__ == '__main__':\n    setup(entry_points=S)\n"},
    "declared-computed": {"setup.py": "setup(entry_points={'console_scripts': [f() for f in all_of_them]})\n"},
    "declared-broken": {"pyproject.toml": "[project\n", "setup.cfg": "[options.entry_points]\nconsole_scripts = a = pkg:go\n"},
}

FILES = [
    ("logs", "weblog.py", _LOGS),
    *(("shop", path, text) for path, text in _SHOP.items()),
    ("steps", "release.py", _STEPS),
    *((tree, path, text) for tree, files in _DECLARED.items() for path, text in files.items()),
    *((tree, path, text) for tree in _DECLARED for path, text in (("pkg/__init__.py", "from .main import go\n"), ("pkg/main.py", _PACKAGE))),
]

#: (reply, loops, branches) and what is thought of it.
REPLIES = [
    (1, "loops over records, buckets by status class, sums the bytes", 1, 2),
    (2, "loops over the characters of the line until one is a digit", 0, 2),
    (3, "dispatches on the type of node and returns what it finds", 1, 0),
    (4, "returns early when the cache is warm, otherwise rebuilds it", None, None),
    (5, "too short", 1, 1),
    (6, "", 1, 1),
    (7, None, 1, 1),
    (8, "walks up the directories, stops at the first that has no marker, then joins the parts that are left over, and returns", 1, 1),
    (9, "one run-on clause that goes on and on without any comma at all until it is far too long to be shown anywhere on the page", 1, 1),
    (10, "either picks the first or the last of them, whichever is there", 1, 0),
    (11, "keeps repeating itself while anything is left in the queue", 0, 1),
    (12, "it repeats the request while the server says that it is busy", 0, 1),
]
