"""The line protocol over TCP: a thread and a session for each connection.

Statements end with ``;`` (not one inside a string or comment); each gets its own reply, in order. When a
client goes, its open transaction is dropped and its locks with it."""

from __future__ import annotations

import socket
import tempfile
import threading

from snaptable import fixed
from snaptable.database import Database
from snaptable.executor import Session
from snaptable.sql.lexer import split_statements

REPLY_BYTES = 16 << 20  # of a reply held in memory


class SqlServer:
    """Bound on construction; port 0 takes any free one, named by ``port``."""

    def __init__(self, db: Database, port: int = fixed.PORT, host: str = "127.0.0.1"):
        self.db = db
        self.socket = socket.create_server((host, port))
        self.port = self.socket.getsockname()[1]
        self.stopping = threading.Event()
        self.threads: list[threading.Thread] = []
        self.clients: set[socket.socket] = set()
        self.lock = threading.Lock()

    def start(self) -> SqlServer:
        self.socket.settimeout(0.2)
        self._spawn(self._accept)
        return self

    def _spawn(self, target, *args) -> None:
        thread = threading.Thread(target=target, args=args, daemon=True)
        self.threads.append(thread)
        thread.start()

    def _accept(self) -> None:
        while not self.stopping.is_set():
            try:
                client, _ = self.socket.accept()
            except TimeoutError:
                continue
            except OSError:
                return
            with self.lock:
                self.clients.add(client)
            self.threads = [t for t in self.threads if t.is_alive()]
            self._spawn(self._serve, client)

    def _serve(self, client: socket.socket) -> None:
        session, held = Session(self.db), b""
        try:
            with client:
                client.settimeout(None)
                client.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                while data := client.recv(65536):
                    held += data
                    try:
                        text = held.decode()
                    except UnicodeDecodeError as e:
                        if len(held) - e.start < 4:  # a character may be cut in two
                            continue
                        text = held.decode(errors="replace")
                    statements, rest = split_statements(text)
                    held = rest.encode()
                    for s in statements:
                        with tempfile.SpooledTemporaryFile(REPLY_BYTES) as reply:  # a long one waits on disk
                            session.reply(s, reply)
                            reply.seek(0)
                            while piece := reply.read(1 << 20):
                                client.sendall(piece)
        except OSError:
            pass
        finally:
            session.close()
            with self.lock:
                self.clients.discard(client)

    def stop(self) -> None:
        self.stopping.set()
        self.socket.close()
        with self.lock:
            for c in self.clients:
                try:
                    c.shutdown(socket.SHUT_RDWR)
                except OSError:
                    pass
        for t in self.threads:
            t.join(5)
