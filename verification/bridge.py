"""Log and dataset views over the given test tables.

The tables hold no network logs, so each view derives one row per table row
with plain arithmetic.  ``oracle.py`` states the same arithmetic in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.operators.harmonize import Synthetic

LOG_FIELDS = ["timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent",
              "bytes_recv", "duration", "event_type", "log_level", "message"]
EXTERNAL_IPS = ["203.0.113.7", "203.0.113.91", "198.51.100.14", "198.51.100.66", "192.0.2.33", "192.0.2.200"]
REMOTE_IPS = ["203.0.113.7", "198.51.100.66", "192.0.2.200"]
MESSAGES = {
    "port_scan": "scan over many ports in short order",
    "ddos": "flood of half-open connections",
    "data_exfiltration": "suspicious upload, likely exfiltration of an unauthorized payload",
    "privilege_escalation": "sudo used to become root, unauthorized, by an exploit with payload",
    "authentication": "credentials rejected, login failed",
}
BRUTE_FORCE_MESSAGES = ["ssh logins failed again and again", "password guessing by brute force"]
OTHER_MESSAGE = "session opened to a remote host"
INTERNAL_SUBNETS = ["10.0.0.", "10.0.1.", "192.168.1."]
BASE_SECONDS = 1704412800  # 2024-01-05 00:00:00 UTC


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(index: Column, *values) -> Column:
    out = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, F.lit(value)).otherwise(out)
    return out


def _message(kind: Column, number: Column) -> Column:
    out = F.when(kind == "brute_force", pick(number % 2, *BRUTE_FORCE_MESSAGES))
    for name, text in MESSAGES.items():
        out = out.when(kind == name, text)
    return out.otherwise(OTHER_MESSAGE)


def net_logs_from(events: DataFrame) -> DataFrame:
    """Logs of an events frame, batch or streaming."""
    e, u, v, t = F.col("event_id"), F.col("user_id"), F.col("value"), F.col("event_type")
    kind = (F.when(t == "click", "connection").when(t == "view", "dns_query")
             .when(t == "signup", "authentication").when(t == "purchase", "file_access")
             .otherwise(pick(e % 5, "port_scan", "brute_force", "ddos",
                             "data_exfiltration", "privilege_escalation")))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) % 2
    seconds = (day.cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60
               + F.second("ts") + F.lit(BASE_SECONDS))
    out = events.select(
        e.alias("id"), F.timestamp_seconds(seconds).alias("event_ts"), kind.alias("event_type"),
        (t == "error").alias("is_attack"), u.alias("_u"), v.alias("_v"))
    e, u, v, kind = F.col("id"), F.col("_u"), F.col("_v"), F.col("event_type")
    is_kind = lambda *names: kind.isin(*names)
    spread = e * 7919
    score = F.when(F.col("is_attack"), (F.lit(-20) - spread % 700) / 1000).otherwise(
        (F.lit(150) - spread % 250) / 1000)
    out = out.withColumns({
        "timestamp": F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "src_ip": F.when(is_kind("port_scan", "brute_force", "ddos"), pick(u % 6, *EXTERNAL_IPS))
            .otherwise(F.concat(pick(u % 3, *INTERNAL_SUBNETS), (u % 20 + 1).cast("string"))),
        "dst_ip": F.when(is_kind("connection", "data_exfiltration"),
                         pick(e % 3, *REMOTE_IPS))
            .when(is_kind("dns_query"), "10.0.0.1")
            .when(is_kind("file_access") & (e % 3 == 0),
                  F.concat(F.lit("10.0.100."), (e % 50 + 2).cast("string")))
            .otherwise(F.concat(F.lit("10.0.1."), (e % 250 + 2).cast("string"))),
        "src_port": (spread % 16383 + 49152).cast("int"),
        "dst_port": F.when(is_kind("port_scan"), pick(e % 3, 4444, 31337, 8080))
            .when(is_kind("brute_force"), pick(e % 2, 22, 3389))
            .when(is_kind("data_exfiltration"), pick(e % 2, 4444, 8443))
            .when(is_kind("privilege_escalation", "file_access"), 445)
            .when(is_kind("dns_query"), 53).when(is_kind("authentication"), 22).otherwise(443),
        "protocol": F.when(is_kind("dns_query"), "DNS")
            .when(is_kind("connection"), pick(e % 2, "TCP", "HTTP"))
            .when(is_kind("ddos"), pick(e % 3, "TCP", "UDP", "ICMP")).otherwise("TCP"),
        "bytes_sent": F.when(is_kind("data_exfiltration"), spread % 4900000 + 100000)
            .when(is_kind("ddos"), spread % 490000 + 10000)
            .when(is_kind("file_access"), spread % 40000 + 30000).otherwise(e * 37 % 5000 + 40),
        "bytes_recv": e * 31 % 15000,
        "duration": F.when(is_kind("port_scan", "ddos", "dns_query"), (e % 50 + 1) / 1000)
            .when(is_kind("data_exfiltration"), v / 10 + 5.0).otherwise(v / 100 + 0.01),
        "log_level": F.when(is_kind("port_scan"), "WARNING").when(is_kind("brute_force"), "ERROR")
            .when(is_kind("ddos", "data_exfiltration", "privilege_escalation"), "CRITICAL")
            .when(is_kind("dns_query"), "DEBUG").otherwise("INFO"),
        "message": _message(kind, e),
        "anomaly_score": score})
    confidence = F.round(F.least(F.greatest(-F.col("anomaly_score") / 0.5, F.lit(0.0)), F.lit(1.0)), 4)
    return out.withColumns({
        "is_anomaly": F.col("anomaly_score") < 0,
        "confidence": F.when(F.col("anomaly_score") < 0, confidence).otherwise(0.0),
    }).drop("_u", "_v", "event_ts")


def net_logs(spark: SparkSession, sf: str) -> DataFrame:
    return net_logs_from(table(spark, sf, "events"))


def raw_json_from(logs: DataFrame) -> DataFrame:
    """(id, value): JSON text with a planted fault chosen by ``id % 17``."""
    fault = F.col("id") % 17
    stamp = F.col("timestamp")
    plain = F.substring(stamp, 1, 19)
    text = logs.withColumns({
        "timestamp": F.when(fault == 4, "not-a-time")
            .when(fault == 5, F.concat(plain, F.lit("+05:30")))
            .when(fault == 6, plain).otherwise(stamp),
        "protocol": F.when(fault == 7, "QUIC").otherwise(F.col("protocol"))})
    fields = F.struct(F.col("id").cast("string").alias("id"), *LOG_FIELDS)
    value = F.to_json(fields, {"ignoreNullFields": "false"})
    value = (F.when(fault == 0, F.regexp_replace(value, r'"src_ip":"[^"]*",', ""))
              .when(fault == 1, F.regexp_replace(value, r'"src_port":(\d+)', '"src_port":"$1"'))
              .when(fault == 2, F.regexp_replace(value, r'"dst_port":\d+', '"dst_port":443.0'))
              .when(fault == 3, F.regexp_replace(value, r'"bytes_sent":\d+', '"bytes_sent":null'))
              .otherwise(value))
    return text.select("id", value.alias("value"))


def raw_json(spark: SparkSession, sf: str) -> DataFrame:
    return raw_json_from(net_logs(spark, sf))


def nsl_like(spark: SparkSession, sf: str) -> DataFrame:
    """Connection records, one per order, with key ``k`` and ``split``."""
    from tidewatch.constants import NSL_COLUMNS

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    flag = lambda condition: condition.cast("long")
    made = {
        "duration": k % 400,
        "protocol_type": pick(k % 4, "tcp", "udp", "icmp", "unk"),
        "service": pick(c % 7, "http", "ftp_data", "smtp", "private", "domain_u", "telnet", "zzz"),
        "flag": pick(k % 12, "SF", "S0", "REJ", "RSTR", "RSTO", "SH", "S1", "S2", "S3", "OTH", "XX", None),
        "src_bytes": F.when(k % 50 == 0, F.lit(-1)).otherwise(F.floor("o_totalprice")).cast("long"),
        "dst_bytes": k * 37 % 10000,
        "hot": k % 3, "num_failed_logins": flag(k % 11 == 0), "num_compromised": k % 2,
        "root_shell": flag(k % 20 == 0), "su_attempted": flag(k % 33 == 0),
        "num_root": flag(k % 13 == 0) * 4,
        "count": k % 511 + 1, "srv_count": c % 511 + 1,
        "serror_rate": k % 101 / 100, "same_srv_rate": c % 101 / 100,
        "dst_host_count": k % 256, "dst_host_srv_count": c % 256,
        "dst_host_same_srv_rate": (k + c) % 101 / 100, "dst_host_serror_rate": k * 3 % 101 / 100,
        "attack_type": F.when(k % 10 < 5, "normal").otherwise(
            pick(k % 9, "neptune", "smurf", "satan", "nmap", "guess_passwd", "warezclient",
                 "buffer_overflow", "rootkit", "mystery")),
    }
    columns = [made.get(n, F.lit(0.0) if n.endswith("_rate") else F.lit(0).cast("long")).alias(n)
               for n in NSL_COLUMNS]
    return table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 5 == 0, "test").otherwise("train").alias("split"), *columns)


def unsw_like(spark: SparkSession, sf: str) -> DataFrame:
    """Flow records, one per line item; ``k`` is not unique."""
    k = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber")
    base = table(spark, sf, "lineitem").withColumn("k", k)
    k = F.col("k")
    flag = lambda condition: condition.cast("long")
    made = {
        "attack_cat": pick(k % 15, None, "", " ", "Normal", " Fuzzers ", "Analysis", "Backdoor",
                           "Backdoors", "DoS", "Exploits", "Generic", "Reconnaissance",
                           "Shellcode", "Worms", "Weird"),
        "label": flag(k % 15 >= 4),
        "proto": pick(k % 6, "TCP ", "udp", "Icmp", "arp", "ospf", None),
        "service": pick((k + 1) % 6, "http", " DNS", "-", None, "ssl", "foo"),
        "state": pick(k % 11, "FIN", "CON", "INT", "ACC", "REQ", "RST", "CLO", "no", "ECO", " FIN ", None),
        "sbytes": F.floor("l_extendedprice").cast("long"), "dbytes": k * 13 % 100000,
        "dur": F.col("l_quantity") * 8 + F.col("l_discount"),
        "ct_state_ttl": k % 13, "sttl": F.when(k % 97 != 0, k * 5 % 256),
        "is_ftp_login": flag(k % 7 == 0), "ct_flw_http_mthd": k % 8, "is_sm_ips_ports": flag(k % 9 == 0),
        "spkts": F.col("l_linenumber").cast("long") * 3, "dpkts": k % 40, "ct_srv_src": k % 60,
        "sload": F.col("l_extendedprice") * 25, "rate": (k % 1500).cast("double"),
        "ct_dst_ltm": k % 50, "ct_srv_dst": k % 62, "ct_dst_src_ltm": k % 130, "dttl": k * 11 % 300,
    }
    return base.select("k", F.when(k % 5 == 0, "test").otherwise("train").alias("split"),
                       *[v.alias(n) for n, v in made.items()])


def keyed_synthetic(key: str = "k") -> Synthetic:
    """Stand-ins by plain arithmetic on the key, so that SQL can state them too."""
    k = F.col(key)
    return Synthetic(
        src_port=k * 7919 % 64511 + 1024,
        hour=k * 31 % 1000 / 1000,
        weekend=(k % 100 < 28).cast("int"),
        port=k * 104729 % 64511 + 1024)
