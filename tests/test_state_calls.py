import pickle
import struct
from types import SimpleNamespace

from pyspark.sql.streaming.proto import StateMessage_pb2 as pb
from test_saved import replay
from test_streaming import run_steps, state

from stackroom.streaming import saved_state
from stackroom.streaming.state_calls import KeyedState


class Server:
    """Spark's client and what it talks to: values by key, answers in the order of the calls."""

    def __init__(self):
        self.sockfile, self.sent, self.answers, self.flushes, self.calls = self, b"", b"", 0, 0
        self.key, self.kept, self.timers = None, {}, []

    def write(self, some):
        self.sent += some

    def flush(self):
        self.flushes += 1
        while self.sent:
            end = 8 + struct.unpack("!ii", self.sent[:8])[1]
            answer = self.answer(pb.StateRequest.FromString(self.sent[8:end])).SerializeToString()
            self.sent, self.calls = self.sent[end:], self.calls + 1
            self.answers += struct.pack("!i", len(answer)) + answer

    def read(self, size):
        found, self.answers = self.answers[:size], self.answers[size:]
        return found

    def answer(self, call):
        value = call.stateVariableRequest.valueStateCall
        if call.HasField("implicitGroupingKeyRequest"):
            self.key = pickle.loads(call.implicitGroupingKeyRequest.setImplicitKey.key)
        elif call.HasField("statefulProcessorCall"):
            self.timers.append((self.key, call.statefulProcessorCall.timerStateCall.register.expiryTimestampMs))
        elif value.HasField("valueStateUpdate"):
            self.kept[self.key] = value.valueStateUpdate.value
        elif value.HasField("clear"):
            del self.kept[self.key]
        elif value.HasField("get"):
            return pb.StateResponse(value=self.kept.get(self.key, b""))
        return pb.StateResponse()

    def _receive_proto_message_with_long_value(self):
        return self.read(4)

    _receive_proto_message_with_timers = _receive_proto_message_with_long_value


def test_calls_of_many_keys_go_together():
    """Waiting for the answer to each call took most of a key's time."""
    server = Server()
    known = KeyedState(SimpleNamespace(_statefulProcessorApiClient=server, getValueState=lambda *_: None), "member", "n bigint")
    keys = [(n, f"é{n}") for n in range(1000)]
    for key in keys:
        known.at(key)
        known.update((key[0],))
        known.registerTimer(key[0] + 1)
    known.fetch(keys)
    known.at(keys[3])
    assert known.get() == (3,) and server.timers == [(key, key[0] + 1) for key in keys]
    known.clear()
    known.at(keys[4])
    known.update((list(range(100_000)),))
    known.fetch(keys[3:6])
    for key, found in zip(keys[2:6], (None, None, (list(range(100_000)),), (5,))):
        known.at(key)
        assert known.get() == found
    assert server.calls > 5000 and server.flushes < server.calls / 20
    server.set_implicit_key((7, "x"))
    server._send_proto_message(pb.StateRequest(stateVariableRequest=pb.StateVariableRequest()).SerializeToString())
    assert server._receive_proto_message_with_long_value() == bytes(4) and server.key == (7, "x")
    known.close()
    assert not {"set_implicit_key", "_send_proto_message"} & set(vars(server))


def test_a_bucket_of_more_keys_than_are_asked_for_at_a_time(spark, tmp_path, monkeypatch):
    """State, late steps and timers of 1,500 keys that are handed over together."""
    monkeypatch.setattr(saved_state, "BUCKETS", 1)
    keys = [(n % 40, f"{n}\t{'é' * (n % 3)}") for n in range(1500)]
    runs = [
        [(*key, "toggle", n % 7, n) for n, key in enumerate(keys)] + [(*key, "put", 8, 2000 + n) for n, key in enumerate(keys[::3])],
        [(50, "z", "put", 1000, 5000)] + [(*key, "delete", 1001, 5001 + n) for n, key in enumerate(keys[::5])],
        [(*key, "toggle", 1002, 8000 + n) for n, key in enumerate(keys[::4])],
    ]
    for part, steps in enumerate(runs):
        run_steps(spark, tmp_path, steps, delay="10 seconds")
        assert sorted(state(spark, tmp_path)) == replay([step for run in runs[: part + 1] for step in run])
    stored = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "member").load()
    assert stored.where("value.settled and value.set_ts is null and size(value.toggles) = 0").count() == 600
