import base64
import gzip
import json


def b64gz(obj) -> str:
    text = obj if isinstance(obj, str) else json.dumps(obj, ensure_ascii=False)
    return base64.b64encode(gzip.compress(text.encode("utf-8"))).decode()


def envelope(group="/ecs/payment-api", stream="s1", events=None, mtype="DATA_MESSAGE", **extra):
    env = {"messageType": mtype, "owner": "1", "logGroup": group, "logStream": stream,
           "subscriptionFilters": ["f"], "logEvents": events if events is not None else []}
    env.update(extra)
    return env
