"""Length-prefixed frames over TCP: one thread for each connection, readers side by side."""

from __future__ import annotations

import socket
import socketserver
import struct
import threading

from .protocol import Request, Service, decode_response

MAX_FRAME, MAX_TOKEN, TIMEOUT = 1 << 28, 4096, 30.0


def send(sock: socket.socket, data: bytes) -> None:
    sock.sendall(struct.pack("<I", len(data)) + data)


def receive(sock: socket.socket, most: int = MAX_FRAME) -> bytes | None:
    """One frame; None if the peer is gone, too slow, or announces too much."""

    def exactly(n: int) -> bytes | None:
        parts = bytearray()
        while len(parts) < n:
            try:
                got = sock.recv(min(n - len(parts), 1 << 16))
            except OSError:
                return None
            if not got:
                return None
            parts += got
        return bytes(parts)

    head = exactly(4)
    if head is None or (size := struct.unpack("<I", head)[0]) > most:
        return None
    return exactly(size)


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self, service: Service, port: int = 0, tokens: bool = False, timeout: float = TIMEOUT):
        outer = self
        self.service, self.tokens, self.wait = service, tokens, timeout

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                self.request.settimeout(outer.wait)
                self.request.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                token = receive(self.request, MAX_TOKEN) if outer.tokens else b""
                if token is None:
                    return
                while (data := receive(self.request)) is not None:
                    answer = outer.service.serve_with_token(token.decode("utf-8", "replace"), data) if outer.tokens else outer.service.serve("local", data)
                    send(self.request, answer)

        super().__init__(("127.0.0.1", port), Handler)

    def start(self) -> int:
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self.server_address[1]


class Client:
    def __init__(self, port: int, host: str = "127.0.0.1", token: str | None = None, timeout: float = TIMEOUT):
        self.sock = socket.create_connection((host, port), timeout)
        if token is not None:
            send(self.sock, token.encode())

    def ask(self, request: Request) -> tuple[int, list[int]]:
        send(self.sock, request.encode())
        answer = receive(self.sock)
        if answer is None:
            raise ConnectionError("the server closed the connection")
        return decode_response(answer)

    def close(self) -> None:
        self.sock.close()
