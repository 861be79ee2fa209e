"""Sums of arrays over the tasks of a barrier stage.

The tasks tell each other their addresses by ``allGather`` and form a ring: an
array is cut into as many pieces as there are tasks, partial sums of the pieces
go round once and the totals once more. Each task sends and receives about
twice the array, however many there are, nothing passes the driver, and all get
the same bits. A lost task ends the stage, which Spark then starts again as a
whole. Connections open with a secret that the driver gave to the stage.
"""

from __future__ import annotations

import hmac
import socket
import threading
from collections.abc import Callable

import numpy as np

PATIENCE = 900.0  # seconds that a task waits for its neighbours


class Ring:
    """``total`` gives the sum over all tasks; one task alone needs no sockets."""

    def __init__(self, rank: int = 0, hosts: tuple[str, ...] = ("",), gather: Callable[[str], list[str]] | None = None, secret: bytes = b""):
        self.rank, self.size, self._to, self._from = rank, len(hosts), None, None
        if self.size == 1:
            return
        with socket.create_server(("", 0)) as server:
            server.settimeout(PATIENCE)
            ports = gather(str(server.getsockname()[1]))
            after = (rank + 1) % self.size
            self._to = socket.create_connection((hosts[after], int(ports[after])), PATIENCE)
            self._to.sendall(secret)
            while self._from is None:
                one, _ = server.accept()
                one.settimeout(PATIENCE)
                if hmac.compare_digest(self._read(one, len(secret)), secret):
                    self._from = one
                else:
                    one.close()
        for s in (self._to, self._from):
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @classmethod
    def of_stage(cls, secret: bytes) -> "Ring":
        """The ring of the barrier stage that this task belongs to."""
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        hosts = tuple(t.address.rsplit(":", 1)[0] for t in context.getTaskInfos())
        return cls(context.partitionId(), hosts, context.allGather, secret)

    @staticmethod
    def _read(s: socket.socket, n: int) -> bytes:
        held = bytearray(n)
        view = memoryview(held)
        at = 0
        while at < n:
            got = s.recv_into(view[at:])
            if not got:
                raise ConnectionError("a task of the stage is gone")
            at += got
        return bytes(held)

    def _swap(self, out: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Send a piece to the task after this one and receive one from the task before, at the same time."""
        failed: list[Exception] = []

        def send() -> None:
            try:
                self._to.sendall(out.tobytes())
            except OSError as e:
                failed.append(e)

        sender = threading.Thread(target=send)
        sender.start()
        got = np.frombuffer(self._read(self._from, like.nbytes), like.dtype)
        sender.join()
        if failed:
            raise failed[0]
        return got

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of ``x`` over all tasks, which call this with arrays of one length and type."""
        x = np.array(x)
        if self.size == 1:
            return x
        pieces = np.array_split(x, self.size)  # views
        for turn in range(self.size - 1):
            pieces[(self.rank - turn - 1) % self.size] += self._swap(pieces[(self.rank - turn) % self.size], pieces[(self.rank - turn - 1) % self.size])
        for turn in range(self.size - 1):
            pieces[(self.rank - turn) % self.size][:] = self._swap(pieces[(self.rank - turn + 1) % self.size], pieces[(self.rank - turn) % self.size])
        return x

    def close(self) -> None:
        for s in (self._to, self._from):
            if s is not None:
                s.close()
