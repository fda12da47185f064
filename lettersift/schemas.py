"""Fixed schemas of the tables the operators read and write."""

# A uid numbers the messages of one folder of one mailbox only.
KEY = ("mailbox", "source_folder", "uid")

HEADER_COLUMNS = [
    "uid", "id", "mailbox", "source_folder", "message_id", "subject", "from_raw", "to_raw", "date", "received_at",
    "arrived_at", "size", "flags",
]
CLASSIFIED_LOG = (
    "id string, date string, sender_email string, sender_name string, subject string, body_text string, "
    "label string, confidence double, source_folder string, processing_state string, saved_at timestamp"
)
CLASSIFICATION_LOG = (
    "timestamp timestamp, input_string string, category string, confidence double, method string"
)
RUN_STATS = (
    "timestamp timestamp, duration_seconds double, total_emails long, transactions long, feed long, "
    "promotions long, inbox long"
)
TRAINING_ROW = (
    "id string, date string, sender_email string, sender_name string, subject string, body_text string, "
    "label string, confidence double, source_folder string"
)
WATERMARK = "mailbox string, hash string, date string, subject string, received_at timestamp"
RECENT_HASHES = "mailbox string, hash string, batch_id long, seq long"
