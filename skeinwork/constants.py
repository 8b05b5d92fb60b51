"""Names, codes and limits that results have to agree on."""

# Error types of a request record.
NO_ERROR, CONNECT_FAIL, NO_RESPONSE, PROTOCOL_ERROR = 0, 1, 2, 3

EXTERNAL = "NOT_FOUND_EXTERNAL"
INTERNAL = "NOT_FOUND_INTERNAL"
EXTERNAL_NAMESPACES = [EXTERNAL, INTERNAL, "EXTERNAL", "external"]
LOOPBACK = "127.0.0.1"

# Socket calls by direction.
READ_CALLS = ["read", "recvfrom", "recvmsg", "readv", "pread", "preadv"]
WRITE_CALLS = ["write", "sendto", "sendmsg", "writev", "sendmmsg", "pwrite", "pwritev"]

# Default event subscription: (name, category); None is any category.
SUBSCRIPTION = [
    ("writev", "net"), ("readv", "net"), ("write", "net"), ("read", "net"),
    ("sendto", "net"), ("recvfrom", "net"), ("sendmsg", "net"), ("recvmsg", "net"),
    ("sendmmsg", "net"),
    ("tcp_close", None), ("tcp_rcv_established", None), ("tcp_drop", None),
    ("tcp_retransmit_skb", None), ("connect", None), ("tcp_connect", None),
    ("tcp_set_state", None), ("procexit", None),
]
SUPPRESSED_COMMANDS = ["containerd", "dockerd", "containerd-shim"]
COMMAND_LENGTH = 16

# Event name -> analyzer family. One event may go to several.
ROUTES = (
    [(n, "network") for n in READ_CALLS[:4] + WRITE_CALLS[:5]]
    + [(n, "tcp_metric") for n in ["tcp_close", "tcp_rcv_established", "tcp_drop", "tcp_retransmit_skb"]]
    + [(n, "tcp_connect") for n in ["connect", "tcp_connect", "tcp_set_state", "write", "writev", "sendto", "sendmsg"]]
    + [(n, "cpu") for n in ["cpu_event", "java_futex_info", "apm_trace_id_event", "apm_span_event", "procexit"]]
)

# Destination port -> protocol, slow thresholds in ms, payload bytes kept.
STATIC_PORTS = {80: "http", 3306: "mysql", 9092: "kafka", 6379: "redis", 53: "dns", 9876: "rocketmq", 10911: "rocketmq"}
SLOW_MS = {"http": 500, "mysql": 100, "kafka": 100, "redis": 100, "dns": 100, "rocketmq": 500}
DEFAULT_SLOW_MS = 500
PAYLOAD_BYTES = 200
SNAP_BYTES = 1000

NOSUPPORT = "NOSUPPORT"
LEARN_AFTER = 50
FORGET_GENERIC_AT = 5000

FD_REUSE_S = 15
NO_RESPONSE_S = 120
CONNECT_WAIT_S = 10
METADATA_GRACE_S = 60

# Bounds of the request time histogram, ns.
TIME_BOUNDS = [10_000_000, 20_000_000, 50_000_000, 80_000_000, 130_000_000, 200_000_000, 300_000_000,
               400_000_000, 500_000_000, 700_000_000, 1_000_000_000, 2_000_000_000, 5_000_000_000, 30_000_000_000]

# Group keys of the pre-aggregation.
_SRC = ["src_node", "src_node_ip", "src_namespace", "src_pod", "src_workload_name", "src_workload_kind",
        "src_service", "src_ip"]
_DST = ["dst_node", "dst_node_ip", "dst_namespace", "dst_pod", "dst_workload_name", "dst_workload_kind",
        "dst_service", "dst_ip", "dst_port", "dnat_ip", "dnat_port", "dst_container_id", "dst_container"]
NET_LABELS = (
    ["pid", "comm", "protocol", "is_server", "container_id"] + _SRC + ["src_container_id", "src_container"] + _DST
    + ["is_error", "is_slow", "http_status_code", "dns_rcode", "sql_error_code", "content_key", "dns_domain",
       "kafka_topic", "rocketmq_error_code"]
)
TCP_LABELS = _SRC + ["src_port", "src_container_id", "src_container"] + _DST
TCP_CONNECT_LABELS = (["pid", "comm"] + _SRC + ["src_container_id", "src_container"] + _DST + ["errno", "success"])
INT_LABELS = {"pid", "dst_port", "src_port", "dnat_port", "http_status_code", "dns_rcode", "sql_error_code",
              "rocketmq_error_code", "errno", "request_tid", "response_tid", "error_type", "end_timestamp"}
BOOL_LABELS = {"is_server", "is_error", "is_slow", "success"}

# Metric aggregation: metric -> [(kind, output)].
NET_AGG = {
    "request_total_time": [("sum", "request_total_time"), ("avg", "request_total_time_avg"), ("count", "request_count")],
    "request_io": [("sum", "request_io")],
    "response_io": [("sum", "response_io")],
}
TCP_AGG = {"srtt_microseconds": [("last", "srtt_microseconds")],
           "retransmit_total": [("sum", "retransmit_total")],
           "packet_loss_total": [("sum", "packet_loss_total")]}
CONNECT_AGG = {"connect_total": [("sum", "connect_total")],
               "connect_duration_nanoseconds_total": [("sum", "connect_duration_nanoseconds_total")]}

# Metric -> exported name, entity (server side) and topology (client side).
ENTITY_METRICS = {
    "request_io": "receive_bytes_total", "response_io": "send_bytes_total",
    "request_total_time": "duration_nanoseconds_total", "request_count": "total",
    "request_total_time_avg": "average_duration_nanoseconds", "request_time_histogram": "request_time_histogram",
}
TOPOLOGY_METRICS = {**ENTITY_METRICS, "request_io": "request_bytes_total", "response_io": "response_bytes_total"}

HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "TRACE", "OPTIONS", "CONNECT"]
HTTP_VERSIONS = ["HTTP/1.0", "HTTP/1.1"]

# SQL verb -> word in front of the object.
SQL_VERBS = [("select", "from"), ("insert", "into"), ("update", "update"), ("delete", "from"),
             ("drop", "index|table|database"), ("create", "index|table|database"), ("alter", "table"),
             ("set", "set"), ("commit", "commit")]

# API groups whose kinds keep their plain name (groups registered by the cluster client library).
BUILTIN_API_GROUPS = [
    "v1", "admissionregistration.k8s.io/v1", "admissionregistration.k8s.io/v1beta1", "internal.apiserver.k8s.io/v1alpha1",
    "apps/v1", "apps/v1beta2", "apps/v1beta1", "authentication.k8s.io/v1", "authentication.k8s.io/v1beta1",
    "authorization.k8s.io/v1", "authorization.k8s.io/v1beta1", "autoscaling/v1", "autoscaling/v2beta1",
    "autoscaling/v2beta2", "batch/v1", "batch/v1beta1", "batch/v2alpha1", "certificates.k8s.io/v1",
    "certificates.k8s.io/v1beta1", "coordination.k8s.io/v1", "coordination.k8s.io/v1beta1", "discovery.k8s.io/v1",
    "discovery.k8s.io/v1beta1", "events.k8s.io/v1", "events.k8s.io/v1beta1", "extensions/v1beta1",
    "flowcontrol.apiserver.k8s.io/v1alpha1", "flowcontrol.apiserver.k8s.io/v1beta1", "networking.k8s.io/v1",
    "networking.k8s.io/v1beta1", "node.k8s.io/v1", "node.k8s.io/v1alpha1", "node.k8s.io/v1beta1", "policy/v1",
    "policy/v1beta1", "rbac.authorization.k8s.io/v1", "rbac.authorization.k8s.io/v1beta1",
    "rbac.authorization.k8s.io/v1alpha1", "scheduling.k8s.io/v1", "scheduling.k8s.io/v1alpha1",
    "scheduling.k8s.io/v1beta1", "storage.k8s.io/v1", "storage.k8s.io/v1alpha1", "storage.k8s.io/v1beta1",
]

# Highest accepted version per broker API key; the lowest is 0. Keys 52-55, 58 and 59 are not assigned.
KAFKA_MAX_VERSION = dict(enumerate([
    9, 12, 7, 11, 5, 3, 7, 3, 8, 8, 4, 7, 4, 4, 5, 5, 4, 1, 3, 7, 6, 2, 4, 4, 3, 3, 3, 1, 3, 2, 2, 2, 4, 2, 2, 2,
    2, 3, 2, 2, 2, 2, 2, 2, 1, 0, 0, 0, 1, 1, 0, 0])) | {56: 0, 57: 0, 60: 0, 61: 0}

DNS_CODES = [("1.*", "FormatErr"), ("2.*", "ServFail"), ("3.*", "NXDomain"), ("4.*", "NotImp"), ("5.*", "Refused")]

# Time slice types of a CPU event.
CPU_TYPES = {0: "on", 1: "file", 2: "net", 3: "futex", 4: "idle", 5: "other", 6: "epoll"}

# Connect return codes that do not end an attempt.
CONNECT_PENDING = [-115, -114, -106, -4]

# Line prefixes written by the in-process agent.
LINE_LOCK, LINE_TXN, LINE_SPAN, LINE_THREAD = "kd-jf@", "kd-txid@", "kd-span@", "kd-tm@"
