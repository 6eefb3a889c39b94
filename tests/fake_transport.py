"""A REST service without a network."""


class FakeTransport:
    """Three pages; the second is refused until the credentials are new."""

    def __init__(self, options):
        self.options = options

    def get(self, url, params, headers):
        if params["page"] == 2 and not headers:
            return 401, {}
        since = params.get("modified_since", "")
        data = [{"id": f"{params['page']}{i}", "modified_time": f"2024-01-0{params['page']}", "owner": {"name": "x"}} for i in range(2)]
        return 200, {"data": [d for d in data if d["modified_time"] > since], "info": {"more_records": params["page"] < 3}}

    def refresh(self):
        return {"Authorization": "new"}
