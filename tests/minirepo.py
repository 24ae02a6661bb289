"""A small repository with everything that the index looks at."""

from pathlib import Path


def make(root: Path) -> Path:
    deps = "\n".join(f'd{i:02d} = "1"' for i in range(12))
    files = {
        ".git/config": '[core]\n[remote "origin"]\n\turl = git@host.example:team/app.git\n',
        ".gitignore": "target/\n*.log\n!keep.log\n", ".hidden": "x", "_priv/z.txt": "z", "empty.txt": "", "a.log": "no", "keep.log": "yes", "target/x.rs": "fn no() {}",
        "README.md": "\n".join(f"line {i}" for i in range(1, 101)) + "\n",
        "Cargo.toml": f'[package]\nname = "app"\nversion = "1.2.3"\nrust-version = "1.80"\nauthors = ["A <a@x>", "B"]\n[[bin]]\nname = "tool"\npath = "src/main.rs"\n[dependencies]\n{deps}\n[workspace]\nmembers = ["web", "py"]\n',
        "web/package.json": '{"name":"web","version":"0.1","engines":{"node":">=20"},"scripts":{"start":"node .","build":"tsc"},"dependencies":{"b":"1","a":"1"},"workspaces":{"packages":["p/*"]}}',
        "py/pyproject.toml": '[project]\nname = "py"\ndependencies = ["requests>=2", "pkg[extra]==1"]\n',
        "poet/pyproject.toml": "[tool.poetry]\nname='poet'\n[tool.poetry.dependencies]\npython='^3'\n" + "\n".join(f"a{i:02d}='1'" for i in range(4)) + "\n" + "\n".join(f"z{i:02d}='1'" for i in range(7)) + "\n",
        "Dockerfile": 'FROM a AS b\nFROM c\nEXPOSE 80 443\nCMD ["x", \\\n "y"]\n', "Makefile": ".PHONY: all\nall: dep\nX := 1\na b: c\n\trecipe: x\n",
        "justfile": 'version := "1"\nbuild arg:\n@quiet:\n', "Procfile": "web: run --port 1\n# c\nbad:\n", "compose.yml": 'services:\n  web:\n    image: x\n  "db":\n    image: y\n',
        "src/main.rs": "use a::b;\nstruct S;\nimpl S {\n    fn go(&self) {}\n}\nfn main() {}\n", "py/app.py": "import os, sys\nfrom a import b\nclass C:\n    pass\n@d\ndef f():\n    pass\n",
        "web/index.ts": "export function f(){}\nconst g = () => 1\ninterface I {}\ntype T = string\nenum E {A}\n", "big.py": "def big():\n    pass\n" + "# needle\n" * 40000,
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bin.dat").write_bytes(b"ab\0cd")
    (root / "latin1.txt").write_bytes(b"caf\xff")
    return root
