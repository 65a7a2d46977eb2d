"""Job-posting analytics on PySpark: crawled pages to listings to ranked matches."""
