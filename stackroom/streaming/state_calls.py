"""State of many keys asked for at a time, in a stateful processor of Spark's.

A processor's own calls wait for Spark's state server one by one, several times for each key; that
took nearly all of a key's time.  Here calls are sent on without waiting, and their answers are
read a chunk at a time.  Written for the worker's protocol of PySpark 4.1.
"""

from __future__ import annotations

import io
import pickle
import struct
from collections import deque
from collections.abc import Callable, Iterable
from functools import cache, partial
from typing import Any

from pyspark.errors import PySparkRuntimeError
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.streaming.proto import StateMessage_pb2 as pb

#: So many answers, or bytes of calls, may be under way: both fit the buffers between the two
#: processes, so that neither waits to write while the other does.
ANSWERS, BYTES = 128, 16_000


class _Plain(pickle.Unpickler):
    """Rows as tuples: Spark's rows bring their schema as text, which costs more to read than they do."""

    def find_class(self, module: str, name: str) -> Any:
        if name == "_create_row_inbound_converter":
            return lambda schema: lambda *values: values
        return str if name == "_parse_datatype_json_string" else super().find_class(module, name)


def _loads(value: bytes) -> Any:
    return _Plain(io.BytesIO(value)).load()


def _field(path: str, content: bytes) -> bytes:
    """A call with one field of bytes, as protobuf writes it; nested messages by name, outermost first."""
    for tag in _tags(path):
        size, length = len(content), bytearray()
        while size > 127:
            length.append(size & 127 | 128)
            size >>= 7
        length.append(size)
        content = tag + length + content
    return content


@cache
def _tags(path: str) -> list[bytes]:
    kind, tags = pb.StateRequest.DESCRIPTOR, []
    for name in path.split("."):
        field = kind.fields_by_name[name]
        tags.append(bytes([field.number << 3 | 2]))
        kind = field.message_type
    return tags[::-1]


class KeyedState:
    """A value state of many keys: what a processor uses as its state and as its handle.

    :meth:`fetch` reads the values of some keys; after :meth:`at` has named one of them, ``get``,
    ``update``, ``clear`` and ``registerTimer`` are about it.  Calls of the worker itself that
    give nothing back go the same way, until :meth:`close`.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str):
        handle.getValueState(name, schema)
        self._client = client = handle._statefulProcessorApiClient
        self._name, self._key, self._named = name, None, None
        self._found: dict[tuple, Any] = {}
        self._open: deque[tuple[int, tuple | None]] = deque()  # bytes of a call, and the key if it asks for its value
        self._bytes = self._unsent = 0
        self._get, self._clear, self._value = self._of_state(get=pb.Get()), self._of_state(clear=pb.Clear()), self._of_state()
        self._instead: dict[str, Any] = {
            "set_implicit_key": self._go_to,
            "_send_proto_message": self._send,
            "_receive_proto_message": self._later,
            "_deserialize_from_bytes": _loads,
        }
        for name in ("_receive_proto_message_with_long_value", "_receive_proto_message_with_timers"):
            self._instead[name] = partial(self._read, getattr(client, name))
        vars(client).update(self._instead)

    def fetch(self, keys: Iterable[tuple]) -> None:
        """Read what is stored for these keys, and forget others."""
        self._found = {}
        for key in keys:
            self.ask(key)
        self.drain()

    def ask(self, key: tuple) -> None:
        self.name(key)
        self._call(self._get, key)

    def at(self, key: tuple) -> None:
        self._key = key

    def get(self) -> tuple | None:
        return self._found.get(self._key)

    def update(self, value: tuple) -> None:
        self.name(self._key)
        self._call(self._value + _field("stateVariableRequest.valueStateCall.valueStateUpdate.value", pickle.dumps(value, 5)))

    def clear(self) -> None:
        if self._key in self._found:
            self.name(self._key)
            self._call(self._clear)

    def registerTimer(self, expiry: int) -> None:
        self.name(self._key)
        register = pb.TimerStateCallCommand(register=pb.RegisterTimer(expiryTimestampMs=expiry))
        self._call(pb.StateRequest(statefulProcessorCall=pb.StatefulProcessorCall(timerStateCall=register)).SerializeToString())

    def name(self, key: tuple) -> None:
        """What is called next is about this key."""
        if key != self._named:
            self._call(_field("implicitGroupingKeyRequest.setImplicitKey.key", pickle.dumps(key, 5)))
            self._named = key

    def drain(self) -> None:
        """Send what is not sent yet, and read all answers under way."""
        self._answers(0, 0)

    def _answers(self, calls: int, size: int) -> None:
        """Read answers, until no more than so many calls, of so many bytes, are under way."""
        file, self._unsent = self._client.sockfile, 0
        file.flush()
        while len(self._open) > calls or self._bytes > size:
            length = struct.unpack("!i", file.read(4))[0]
            sent, key = self._open.popleft()
            self._bytes -= sent
            if not length:
                continue
            answer = pb.StateResponse.FromString(file.read(length))
            if answer.statusCode:
                raise PySparkRuntimeError(f"Error in a call of state {self._name}: {answer.errorMessage}")
            if key is not None and answer.value:
                self._found[key] = _loads(answer.value)

    def close(self) -> None:
        self.drain()
        for name in self._instead:
            delattr(self._client, name)

    def _of_state(self, **call: Any) -> bytes:
        value = pb.ValueStateCall(stateName=self._name, **call)
        return pb.StateRequest(stateVariableRequest=pb.StateVariableRequest(valueStateCall=value)).SerializeToString()

    def _call(self, message: bytes, key: tuple | None = None) -> None:
        if len(self._open) >= ANSWERS or self._bytes + len(message) > BYTES:
            self._answers(ANSWERS // 2, max(0, BYTES // 2 - len(message)))
        self._client.sockfile.write(struct.pack("!ii", 0, len(message)) + message)
        self._open.append((len(message), key))
        self._bytes += len(message)
        self._unsent += 1
        if self._unsent >= ANSWERS // 4:  # the server goes on while more is made ready
            self._client.sockfile.flush()
            self._unsent = 0

    # --- the worker's own calls

    def _go_to(self, key: tuple) -> None:
        self.name(tuple(part.item() if hasattr(part, "item") else part for part in key))  # frames have NumPy's numbers

    def _send(self, message: bytes) -> None:
        self._named = None  # it may name another key
        self._call(message)

    def _later(self) -> tuple[int, str, bytes]:
        return 0, "", b""

    def _read(self, receive: Callable[[], Any]) -> Any:
        self._bytes -= self._open.pop()[0]  # the client reads this one's answer itself
        self.drain()
        return receive()
