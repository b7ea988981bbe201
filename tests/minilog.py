"""Rows of the mini-log of three cases."""

import datetime as dt

T0 = dt.datetime(2018, 6, 1, 9)
CASES = {
    "DOC1_ITEM1": ("Create Purchase Order Item|Record Goods Receipt|Vendor creates invoice|Record Invoice Receipt|Clear Invoice",
                   "user_001 batch_06 NONE user_002 batch_00", [1000, 1000, 1000, 1000, 0]),
    "DOC1_ITEM2": ("Create Purchase Order Item|Vendor creates invoice|Record Invoice Receipt|Clear Invoice", "user_001 NONE user_002 batch_00", [500, 500, 500, 0]),
    "DOC2_ITEM1": ("Create Purchase Order Item|Record Goods Receipt|Record Invoice Receipt|Cancel Invoice Receipt|Record Invoice Receipt|Clear Invoice",
                   "user_001 batch_06 user_003 user_003 user_003 batch_00", [2000, 2000, 1800, -1800, 2000, 2000]),
}
EVENTS_DDL = "case_id string, activity string, ts timestamp_ntz, event_seq long, resource string, event_value double"
CASES_DDL = ("case_id string, purchasing_document string, item_type string, gr_based_iv boolean, goods_receipt boolean, company string, vendor string, "
             "vendor_name string, document_type string, item_category string")


def event_rows():
    out = []
    for case, (activities, resources, values) in CASES.items():
        for k, (a, r, v) in enumerate(zip(activities.split("|"), resources.split(), values)):
            out.append((case, a, T0 + dt.timedelta(days=k), k, r, float(v)))
    return out


def case_rows():
    gr = "3-way match, invoice after GR"
    return [("DOC1_ITEM1", "DOC1", "Standard", True, True, "companyID_0000", "vendorID_0000", "vendor_0000", "EC Purchase order", gr),
            ("DOC1_ITEM2", "DOC1", "Standard", False, False, "companyID_0000", "vendorID_0001", "vendor_0001", "EC Purchase order", "2-way match"),
            ("DOC2_ITEM1", "DOC2", "Standard", True, True, "companyID_0001", "vendorID_0000", "vendor_0000", "EC Purchase order", gr)]
