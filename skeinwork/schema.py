"""Table layouts."""

from pyspark.sql import types as T

_L, _S, _I, _B = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _st(**cols):
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


EVENT = _st(seq=_L, ts_ns=_L, name=_S, category=_S, latency_ns=_L, pid=_L, tid=_L, comm=_S, container_id=_S, fd=_I,
            l4=_S, is_server_fd=_B, sip=T.ArrayType(_L), dip=T.ArrayType(_L), sport=_I, dport=_I, res=_L,
            data=T.BinaryType(), attrs=T.MapType(_S, T.BinaryType()))

HISTOGRAM = _st(sum=_L, count=_L, bounds=T.ArrayType(_L), buckets=T.ArrayType(_L))

# Result record as the agent serialises it: {"Name", "Metrics": [{"Name", "Data": {"Value"}}], "Labels", "Timestamp"}.
RECORD = _st(
    name=_S,
    metrics=T.ArrayType(_st(Name=_S, Data=_st(Value=_L))),
    labels=T.MapType(_S, _S),
    timestamp=_L,
)

CPU_EVENT = _st(startTime=_L, endTime=_L, typeSpecs=T.ArrayType(_L), runqLatency=T.ArrayType(_L),
                timeType=T.ArrayType(_I), onInfo=_S, offInfo=_S, log=_S, stack=_S)
LOCK_EVENT = _st(startTime=_L, endTime=_L, dataValue=_S)
TXN_EVENT = _st(timestamp=_L, traceId=_S, isEntry=_I, protocol=_S, url=_S)
SPAN_EVENT = _st(startTime=_L, endTime=_L, traceId=_S, name=_S)
INNER_CALL = _st(startTime=_L, endTime=_L, trace=RECORD)

SEGMENT_LISTS = {
    "cpuEvents": T.ArrayType(CPU_EVENT), "javaFutexEvents": T.ArrayType(LOCK_EVENT),
    "transactionIds": T.ArrayType(TXN_EVENT), "spans": T.ArrayType(SPAN_EVENT), "innerCalls": T.ArrayType(INNER_CALL),
}

POD = _st(uid=_S, name=_S, namespace=_S, ip=_S, host_ip=_S, node=_S, host_network=_B, labels=T.MapType(_S, _S),
          owners=T.ArrayType(_st(kind=_S, name=_S, api_version=_S, controller=_B)),
          statuses=T.ArrayType(_st(name=_S, container_id=_S)),
          containers=T.ArrayType(_st(name=_S, ports=T.ArrayType(_st(container_port=_I, host_port=_I)))))
SERVICE = _st(name=_S, namespace=_S, cluster_ip=_S, type=_S, selector=T.MapType(_S, _S),
              ports=T.ArrayType(_st(port=_I, node_port=_I)))
NODE = _st(name=_S, addresses=T.ArrayType(_st(type=_S, address=_S)))
REPLICASET = _st(name=_S, namespace=_S, owners=T.ArrayType(_st(kind=_S, name=_S, api_version=_S, controller=_B)))
