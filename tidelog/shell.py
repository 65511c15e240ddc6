"""A small command shell: SET, GET, DEL, SCAN, BEGIN, INCR, COMMIT, ROLLBACK, INFO, INSPECT, FLUSH, COMPACT, EXPIRE, VACUUM,
BACKUP, RESTORE."""

from __future__ import annotations

import shlex
import sys

from pyspark.sql import SparkSession

from tidelog.database import Conflict, Database


class Shell:
    def __init__(self, db: Database):
        self.db, self.tx = db, None

    def run(self, line: str) -> str:
        words = shlex.split(line)
        if not words:
            return ""
        verb, rest = words[0].upper(), words[1:]
        action = getattr(self, f"do_{verb.lower()}", None)
        if action is None:
            return f"ERR unknown command {verb}"
        try:
            return action(*rest)
        except TypeError:
            return f"ERR wrong number of arguments for {verb}"
        except (ValueError, Conflict, RuntimeError) as error:
            return f"ERR {error}"

    def do_set(self, key: str, value: str) -> str:
        (self.tx or self.db).put(key, value)
        return "OK"

    def do_get(self, key: str) -> str:
        value = (self.tx or self.db).get(key)
        return "(nil)" if value is None else value.decode(errors="replace")

    def do_del(self, key: str) -> str:
        (self.tx or self.db).delete(key)
        return "OK"

    def do_incr(self, key: str) -> str:
        """An absent key counts as 0; a value that is no whole number is an error."""
        own = self.tx or self.db
        n = int((own.get(key) or b"0").decode()) + 1
        own.put(key, str(n))
        return str(n)

    def do_scan(self, start: str = "", end: str = "") -> str:
        return "\n".join(f"{bytes(r['key']).decode(errors='replace')} {bytes(r['value']).decode(errors='replace')}" for r in self.db.scan(start, end).toLocalIterator())

    def do_begin(self) -> str:
        if self.tx:
            raise ValueError("a transaction is open")
        self.tx = self.db.begin()
        return "OK"

    def do_commit(self) -> str:
        if not self.tx:
            raise ValueError("no transaction is open")
        tx, self.tx = self.tx, None
        tx.commit()
        return "OK"

    def do_rollback(self) -> str:
        if self.tx:
            self.tx.rollback()
        self.tx = None
        return "OK"

    def do_info(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.db.info().items())

    def do_inspect(self) -> str:
        """The runs of the present manifest."""
        return "\n".join(f"{r['run_id']} {r['path']} {r['min_key'].decode(errors='replace')}..{r['max_key'].decode(errors='replace')} rows={r['n_rows']} level={r['level']}" for r in self.db.current["runs"])

    def do_flush(self) -> str:
        self.db.flush()
        return "OK"

    def do_compact(self) -> str:
        self.db.compact()
        return "OK"

    def do_expire(self, keep: str = "1") -> str:
        return str(self.db.expire(int(keep)))

    def do_vacuum(self) -> str:
        return str(self.db.vacuum())

    def do_backup(self, target: str) -> str:
        self.db.backup(target)
        return "OK"

    def do_restore(self, backup: str, path: str) -> str:
        """A backup as a database at a new path, with which the shell goes on."""
        if self.tx:
            raise ValueError("a transaction is open")
        self.db.close()
        self.db = Database.restore(self.db.spark, backup, path, self.db.options)
        return "OK"


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    shell = Shell(Database.open(spark, args[0]))
    for line in sys.stdin:
        print(shell.run(line))
    shell.db.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
