"""The reference's own test inputs, rebuilt from FIXTURES.md section 1."""

from datetime import datetime, timedelta

from pyspark.sql import types as T

ASOF = datetime(2024, 3, 1, 12, 0, 0)

NPE_TRACE = (
    "java.lang.NullPointerException: Cannot invoke getEmail() on null\n"
    "\tat com.example.OrderService.processOrder(OrderService.java:23)\n"
    "\tat com.example.OrderController.createOrder(OrderController.java:45)\n")
PAYMENT_TRACE = (
    "java.lang.IllegalStateException: Payment gateway unavailable\n"
    "\tat com.example.PaymentService.charge(PaymentService.java:89)\n"
    "\tat com.example.OrderService.processOrder(OrderService.java:27)\n")
# outer: 4 frames (third native), 2 user frames; one cause with 2 frames
PARSE_TRACE = (
    "java.lang.RuntimeException: Failed to process\n"
    "\tat com.example.OrderService.processOrder(OrderService.java:23)\n"
    "\tat java.util.ArrayList.forEach(ArrayList.java:1511)\n"
    "\tat sun.reflect.NativeMethodAccessorImpl.invoke0(Native Method)\n"
    "\tat com.example.OrderController.createOrder(OrderController.java:45)\n"
    "Caused by: java.lang.IllegalStateException: Invalid state\n"
    "\tat com.example.Order.validate(Order.java:12)\n"
    "\tat com.example.OrderService.processOrder(OrderService.java:21)\n"
    "\t... 4 more\n")

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("app_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("stack_trace", T.StringType()), T.StructField("file_name", T.StringType()),
    T.StructField("line_number", T.IntegerType()), T.StructField("method_name", T.StringType()),
    T.StructField("class_name", T.StringType()), T.StructField("thread_name", T.StringType()),
    T.StructField("mdc_context", T.StringType()),
])


def entries():
    rows = []
    i = 1
    for k in range(5):
        rows.append((i, "app-0", ASOF - timedelta(minutes=k), "ERROR", "com.example.OrderService",
                     f"Error processing order {1000 + k}", NPE_TRACE, "OrderService.java", 23,
                     "processOrder", "com.example.OrderService", "main", None))
        i += 1
    rows.append((i, "app-0", ASOF - timedelta(minutes=10), "ERROR", "com.example.PaymentService",
                 "Payment failed for customer 12345", PAYMENT_TRACE, "PaymentService.java", 89, "charge",
                 "com.example.PaymentService", "main", None))
    i += 1
    for k in range(10):
        rows.append((i, "app-0", ASOF - timedelta(minutes=2 * k), "INFO", "com.example.Api",
                     f"Processing request {k}", None, None, None, None, None, "main", None))
        i += 1
    rows.append((i, "app-0", ASOF - timedelta(minutes=5), "WARN", "com.example.Cache",
                 "Cache miss for key: user_profile_123", None, None, None, None, None, "main", None))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(rows if rows is not None else entries(), SCHEMA)
